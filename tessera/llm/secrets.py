"""Secret scanning with DataFrame functions only.

Three fixed patterns give the base spans.  Character Markov models of random
strings and of ordinary identifiers, trained from labelled samples, judge every
other long run of key characters by its log-likelihood ratio and add those that
look random (kind ``markov``).

Spans count code points, end exclusive.  A null text is empty and has none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_WORD = r"(?i:password|passwd|secret|token|api_?key)"
#: A run that begins with its only possible start and takes all it can is the same match as the open pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Characters of keys; anything else counts as one further symbol.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

#: Words of ordinary identifiers for the default training sample.
IDENTIFIER_WORDS = (
    "account action address api app array auth base batch block body buffer build button cache call channel check "
    "class clean client close cluster code color column command common config connect content context control copy "
    "core count create current data database date debug default delete device display document download edit element "
    "email enable end entry error event example execute export factory field file filter find first flag folder form "
    "format frame function gateway get global group handler header height hidden home host html http image import "
    "index info init input install instance integer interface item job json key label language last layout length "
    "level library limit line link list load local lock login long main manager map mapping mask master match max "
    "member memory menu message meta method min mode model module monitor mount name navigation network node number "
    "object office offset open option order output owner package page panel parent parse partition path pattern "
    "payment person place plan platform player plugin point policy pool port position post prefix print private "
    "process product profile project property protocol provider proxy public query queue range read record region "
    "register release remote render report request reset resource response result return role root route row rule "
    "run sample save scale schedule schema scope screen script search section security select send sequence server "
    "service session setting shape share size sort source space stack start state static status step storage store "
    "stream string style submit summary support switch system table target task template test text theme thread "
    "time title tool total trace track transaction transform tree trigger type unit update upload user util value "
    "vector version video view visible volume wait web width window word worker wrapper write zone"
).split()


# --------------------------------------------------------------------- models


def default_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled samples ``(text, label)`` made by rule: 1 random, 0 ordinary.

    Random strings are digests in several alphabets.  Ordinary identifiers are
    two to five words joined in the common styles, some with a number.
    """
    words = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    plain = F.base64(F.unhex(digest))
    random = F.element_at(
        F.array(
            plain,
            F.translate(plain, "+/=", "-_"),
            F.regexp_replace(plain, "[+/=]", ""),
            F.upper(F.regexp_replace(plain, "[+/=]", "")),
            F.lower(F.regexp_replace(plain, "[+/=]", "")),
            digest,
        ),
        (F.pmod("id", F.lit(6)) + 1).cast("int"),
    )
    count = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(4)) + 2
    parts = F.slice(F.array(*[pick(k) for k in range(5)]), F.lit(1), count.cast("int"))
    number = F.when(F.pmod("id", F.lit(3)) == 0, F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string")).otherwise("")
    style = F.pmod("id", F.lit(6))
    ordinary = F.concat(
        F.when(style == 0, F.array_join(parts, "_"))
        .when(style == 1, F.array_join(parts, "-"))
        .when(style == 2, F.array_join(parts, "/"))
        .when(style == 3, F.array_join(F.transform(parts, F.initcap), ""))
        .when(style == 4, F.upper(F.array_join(parts, "_")))
        .otherwise(F.array_join(parts, "")),
        number,
    )
    ids = spark.range(n)
    return ids.select(random.alias("text"), F.lit(1).alias("label")).unionByName(
        ids.select(ordinary.alias("text"), F.lit(0).alias("label"))
    )


def _symbols(text: Column) -> Column:
    """0-based symbol numbers of a text's characters; the last number is for all others."""
    return F.transform(
        F.split(text, ""), lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(len(ALPHABET))
    )


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of every symbol pair, random against ordinary.

    ``samples`` has ``text`` and ``label`` (1 random, 0 ordinary); null or
    one-character texts teach nothing.  What comes to the driver is the table
    of pair counts, bounded by twice the square of the alphabet.
    """
    k = len(ALPHABET) + 1
    s = samples.where("label in (0, 1) and length(text) > 1").select("label", _symbols(F.col("text")).alias("s"))
    pairs = s.select(
        "label",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.element_at("s", i) * k + F.element_at("s", i + 1))).alias("p"),
    )
    counts = {0: [smoothing] * (k * k), 1: [smoothing] * (k * k)}
    for r in pairs.groupBy("label", "p").count().collect():
        counts[r["label"]][r["p"]] += r["count"]
    logs = {}
    for label, c in counts.items():
        rows = [sum(c[i * k : (i + 1) * k]) for i in range(k)]
        logs[label] = [math.log(c[p] / rows[p // k]) for p in range(k * k)]
    return [round(a - b, 6) for a, b in zip(logs[1], logs[0], strict=True)]


# ---------------------------------------------------------------------- spans


def _spans(matches: Column, gaps: Column, kind: str, keep: Column | None = None) -> Column:
    """Spans of a pattern from its matches and the pieces of text between them."""
    none = F.array().cast(SPANS)
    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.element_at(gaps, i))
        end = start + F.length(F.element_at(matches, i))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        found = F.concat(acc["found"], F.array(span))
        if keep is not None:
            found = F.when(F.element_at(keep, i), found).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.when(
        F.size(matches) > 0,
        F.aggregate(F.sequence(F.lit(1), F.size(matches)), zero, step, lambda a: a["found"]),
    ).otherwise(none)


def scan(
    docs: DataFrame, model: list[float], text_col: str = "text", out_col: str = "secret_spans", threshold: float = 7.0
) -> DataFrame:
    """Add ``out_col``: all spans as structs ``(start, rank, kind, end)``, by start and kind.

    ``threshold`` is the log-likelihood ratio that a run must exceed: about the
    log of how many ordinary runs there are for one secret.  A run that touches
    a base span adds nothing.  All columns of ``docs`` stay; work columns have
    names of their own and go at the end.
    """
    t = "__text"
    k = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    none = F.array().cast("array<string>")
    col = F.col
    names = docs.columns

    def found(name: str, pattern: str, group: int, quick: Column) -> Column:
        return F.when(quick, F.regexp_extract_all(col(t), F.lit(pattern), F.lit(group))).otherwise(none).alias(name)

    def gaps(name: str, pattern: str, quick: Column) -> Column:
        return F.when(quick, F.split(col(t), pattern, -1)).otherwise(none).alias(name)

    a = docs.select("*", F.coalesce(col(text_col).cast("string"), F.lit("")).alias(t))
    a = a.select(
        "*",
        col(t).rlike(ASSIGN_WORD).alias("__q1"),
        F.contains(col(t), F.lit("AKIA")).alias("__q2"),
        col(t).rlike(HEX).alias("__q3"),
        col(t).rlike(RUN).alias("__q4"),
    )
    a = a.select(
        "*",
        found("__m1", ASSIGN, 0, col("__q1")),
        found("__v1", ASSIGN, 2, col("__q1")),
        gaps("__g1", ASSIGN, col("__q1")),
        found("__m2", ACCESS, 0, col("__q2")),
        gaps("__g2", ACCESS, col("__q2")),
        found("__m3", HEX, 0, col("__q3")),
        gaps("__g3", HEX, col("__q3")),
        found("__m4", RUN, 0, col("__q4")),
        gaps("__g4", RUN, col("__q4")),
    )

    def ratio(run: Column) -> Column:
        return F.aggregate(
            _symbols(run),
            F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
            lambda s, x: F.struct(
                x.cast("int").alias("last"),
                F.when(s["last"] < 0, s["sum"]).otherwise(s["sum"] + F.element_at(table, (s["last"] * k + x + 1).cast("int"))).alias("sum"),
            ),
            lambda s: s["sum"],
        )

    a = a.select(
        "*",
        F.concat(
            _spans(col("__m1"), col("__g1"), "assign", F.transform("__v1", lambda v: F.length(v) >= 8)),
            _spans(col("__m2"), col("__g2"), "access"),
            _spans(col("__m3"), col("__g3"), "hex"),
        ).alias("__base"),
        _spans(col("__m4"), col("__g4"), "markov", F.transform("__m4", lambda r: ratio(r) > threshold)).alias("__more"),
    )
    apart = F.filter(
        "__more", lambda m: ~F.exists("__base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    )
    return a.select(*[col(f"`{c}`") for c in names], F.array_sort(F.concat("__base", apart)).alias(out_col))


def listed(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    some = F.filter(spans, lambda s: s["kind"] != "markov") if base_only else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mark: str = "[SECRET]", threshold: float = 7.0) -> DataFrame:
    """Replace every span found by ``mark``; spans that overlap are replaced as one.

    Texts without a span, null ones included, stay as they are.
    """
    names = docs.columns
    s = scan(docs, model, text_col, "__spans", threshold)
    text = F.col(f"`{text_col}`")
    # walk the spans in order: text so far, and where the copied part ends
    walk = F.aggregate(
        "__spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, x: F.when(
            x["start"] >= a["at"],
            F.struct(
                F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark)).alias("out"),
                x["end"].alias("at"),
            ),
        ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    new = F.when(F.size("__spans") > 0, walk).otherwise(text)
    return s.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in names])

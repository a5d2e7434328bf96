"""Stage registries and configuration: named DataFrame stages run in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.repair import repaired
from tessera.operators import annotate, detections, masks, metrics, raster, split, tiling, windows

Tables = dict[str, DataFrame]


class Config:
    """A tree of settings with attribute and item access; merges don't change their inputs."""

    def __init__(self, data: dict[str, Any] | None = None):
        self._data = dict(data or {})

    @classmethod
    def from_yaml(cls, text_or_path: str) -> Config:
        import yaml

        if "\n" in text_or_path:
            data = yaml.safe_load(text_or_path)
        else:
            with open(text_or_path) as f:
                data = yaml.safe_load(f)
        if data is None:
            data = {}
        if not isinstance(data, dict):
            raise ValueError("the top level of a configuration must be a mapping")
        return cls(data)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or name not in self._data:
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Any:
        v = self._data[name]
        return Config(v) if isinstance(v, dict) else v

    def get(self, path: str, default: Any = None) -> Any:
        """A value by its dotted path."""
        v: Any = self._data
        for part in path.split("."):
            if not isinstance(v, dict) or part not in v:
                return default
            v = v[part]
        return v

    def to_dict(self) -> dict[str, Any]:
        return merged(self._data, {})

    def merge(self, other: dict[str, Any] | Config) -> Config:
        return Config(merged(self._data, other._data if isinstance(other, Config) else other))

    def with_overrides(self, settings: list[str]) -> Config:
        """Apply ``a.b=value`` texts; malformed ones are ignored."""
        out = self
        for s in settings:
            path, eq, raw = s.partition("=")
            if eq and path.strip():
                tree: dict[str, Any] = {}
                here = tree
                *parents, last = path.strip().split(".")
                for p in parents:
                    here = here.setdefault(p, {})
                here[last] = coerced(raw.strip())
                out = out.merge(tree)
        return out


def merged(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
    out = {k: merged(v, {}) if isinstance(v, dict) else v for k, v in a.items()}
    for k, v in b.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else (merged(v, {}) if isinstance(v, dict) else v)
    return out


def coerced(raw: str) -> Any:
    """Text as truth value, whole number, number or text, whichever fits first."""
    if raw.lower() in ("true", "false"):
        return raw.lower() == "true"
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    return raw


MODES = ("inference", "evaluation")
SECTIONS = ("pipeline", "model", "paths", "prediction")


def checked(config: Config) -> Config:
    """The settings of a prediction run, or an error that names what is missing or out of range."""
    for section in SECTIONS:
        if not isinstance(config.get(section), dict):
            raise KeyError(f"section {section} is missing")
    mode = config.get("pipeline.mode", "")
    if mode not in MODES:
        raise ValueError(f"pipeline.mode must be one of {', '.join(MODES)}, not {mode!r}")
    for name in ("prediction.conf", "prediction.iou", "prediction.global_nms_iou", "evaluation.iou_threshold"):
        v = config.get(name, 0.5)
        if isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 1:
            raise ValueError(f"{name} must be a number from 0 to 1, not {v!r}")
    return config


# ---------------------------------------------------------------- stages


@dataclass
class Registry:
    """Stages by name.  A stage takes the tables so far and its settings and returns the tables."""

    stages: dict[str, Callable[[Tables, Config], Tables]] = field(default_factory=dict)

    def stage(self, name: str):
        def add(f: Callable[[Tables, Config], Tables]):
            self.stages[name] = f
            return f

        return add

    def chosen(self, config: Config, only: list[str] | None = None) -> list[str]:
        """Names to run, in the configuration's order; ``only`` overrides its ``enabled`` flags."""
        listed = config.get("stages", [])
        unknown = [s["name"] for s in listed if s["name"] not in self.stages]
        if unknown:
            raise ValueError(f"unknown stages: {', '.join(unknown)}")
        return [s["name"] for s in listed if (s["name"] in only if only is not None else s.get("enabled", True))]

    def run(self, tables: Tables, config: Config, only: list[str] | None = None) -> Tables:
        for name in self.chosen(config, only):
            tables = {**tables, **self.stages[name](tables, Config(config.get(name, {})))}
        return tables


def with_removed(registry: Registry, tables: Tables, config: Config, only: list[str] | None = None, table: str = "predictions") -> tuple[Tables, DataFrame]:
    """Run the stages, and count what each removed: ``step, stage, image, removed``, an image's row null for all.

    Whether filtered or raw predictions go on is the caller's choice: the input
    tables are left as they are.
    """
    counts = None
    for step, name in enumerate(registry.chosen(config, only)):
        after = registry.run(tables, config, [name])
        gone = masks.removed_count(tables[table], after[table]).select(F.lit(step).alias("step"), F.lit(name).alias("stage"), F.col("image").cast("string").alias("image"), "removed")
        counts, tables = gone if counts is None else counts.unionByName(gone), after
    if counts is None:
        counts = tables[table].sparkSession.createDataFrame([], "step int, stage string, image string, removed long")
    return tables, counts


postprocessing = Registry()


@postprocessing.stage("coastline_filter")
def _coastline(tables: Tables, cfg: Config) -> Tables:
    return {"predictions": masks.coastline_filter(tables["predictions"], tables["masks"], cfg.get("min_area_fraction", 0.5))}


@postprocessing.stage("buildings_filter")
def _buildings(tables: Tables, cfg: Config) -> Tables:
    return {"predictions": masks.buildings_filter(tables["predictions"], tables["masks"], cfg.get("max_overlap_fraction", 0.3))}


preprocessing = Registry()


@preprocessing.stage("radiometric")
def _radiometric(tables: Tables, cfg: Config) -> Tables:
    bands = cfg.get("bands")
    return {"blocks": raster.radiometric(tables["blocks"], cfg.get("lo_percentile", 1.0), cfg.get("hi_percentile", 99.9), cfg.get("gamma", 1.0), tuple(bands) if bands else None)}


@preprocessing.stage("spatial")
def _spatial(tables: Tables, cfg: Config) -> Tables:
    scale, method = cfg.get("upscale_ratio", 1.0), cfg.get("interpolation", "cubic")
    images = raster.scaled_meta(tables["images"], scale)
    images = images.withColumns({"width": F.col("new_width"), "height": F.col("new_height")}).drop("new_width", "new_height", "sx", "sy")
    return {"images": images, "blocks": windows.resample(tables["blocks"], tables["images"], scale, method)}


@preprocessing.stage("annotations")
def _annotations(tables: Tables, cfg: Config) -> Tables:
    settings = annotate.AnnotationConfig(
        {int(k): int(v) for k, v in cfg.get("class_map", {}).items()}, tuple(cfg.get("skip_classes", ())), cfg.get("min_visible", 0.1), cfg.get("min_size_px", 2.0)
    )
    return {"labels": annotate.convert(tables["annotations"], tables["images"], settings).withColumnRenamed("ordinal", "line_no")}


@preprocessing.stage("split")
def _split(tables: Tables, cfg: Config) -> Tables:
    settings = split.SplitConfig(
        (cfg.get("train_ratio", 0.7), cfg.get("val_ratio", 0.15), cfg.get("test_ratio", 0.15)),
        tuple(cfg.get("priority_class_ids", ())), cfg.get("priority_weight", 3.0), cfg.get("random_seed", 42),
    )
    assigned = split.assign(tables["images"], split.profiles(tables["labels"]), settings)
    return {"images": tables["images"].drop("split").join(assigned, "image")}


@preprocessing.stage("tiling")
def _tiling(tables: Tables, cfg: Config) -> Tables:
    size, overlap = cfg.get("tile_size", 640), cfg.get("overlap", 64)
    images = tables["images"]
    if "splits" in cfg.to_dict():
        images = images.where(F.col("split").isin(*cfg.get("splits")))
    tiles = tiling.tile_grid(images, size, overlap)
    out = {"tiles": tiles, "tile_labels": tiling.project_labels(tables["labels"], tiles, size, overlap, cfg.get("min_visible_frac", 0.1))}
    if "blocks" in tables:
        # tiles that are one value throughout have no pixels here; they stay in the grid
        out["tile_pixels"] = windows.cut_tiles(tables["blocks"], tiles, size)
    return out


def predict(tables: Tables, detector: Callable, config: Config) -> DataFrame:
    """Detections of all tiles by a user's ``detector``, then global suppression.

    ``detector`` is an iterator function for ``mapInPandas`` over ``tiles``
    that yields ``image, ordinal, class_id, confidence, ring``; rings that cross
    themselves are repaired.
    """
    schema = "image string, ordinal long, class_id int, confidence double, ring array<struct<x:double,y:double>>"
    found = tables["tiles"].mapInPandas(detector, schema).where(f"confidence >= {float(config.get('prediction.conf', 0.2))}")
    found = found.withColumn("ring", repaired(F.col("ring"))).where(F.size("ring") >= 3)
    return detections.suppress(found, config.get("prediction.global_nms_iou", 0.2))


def evaluate(
    predictions: DataFrame, truths: DataFrame, raw: DataFrame | None, threshold: float, names: dict[int, str] | None = None, predicted: DataFrame | None = None
):
    """Evaluation of filtered predictions: ``(metrics table, evaluation rows)``.

    Only images with ground truth count, and of these only those of
    ``predicted``, a table of the images that have a prediction file, where it
    is given.  Rows of ``raw`` that the filters removed are reported as
    deleted, outside the counts.
    """
    if predicted is not None:
        truths = truths.join(predicted.select("image").distinct(), "image", "left_semi")
    with_truth = truths.select("image").distinct()
    p = predictions.join(with_truth, "image", "left_semi")
    p, t = detections.labelled(p, truths, detections.match(p, truths, threshold))
    gone = detections.deleted((predictions if raw is None else raw).join(with_truth, "image", "left_semi"), p)
    return metrics.table(detections.class_counts(p, t), names), detections.evaluation_rows(p, t, gone)

"""Config-driven preparation: load, reshape, rename, clean, transform, save, profile."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from sievework.functions.numbers import nan_to_null
from sievework.operators import binning, categories, missing, profile, scaling
from sievework.operators.filters import drop_missing
from sievework.plans import recipes
from sievework.session import staged
from sievework.sources.files import cast_declared, require_columns, save_parquet, scan_parquet


@dataclass(frozen=True)
class Attribute:
    """A declared column: its type, an optional new name, values that mean missing."""

    type: str
    rename: str | None = None
    missing_values: tuple = ()


@dataclass(frozen=True)
class Step:
    """One configured step on one attribute."""

    attribute: str
    action: str
    args: tuple = ()
    kwargs: dict = field(default_factory=dict)
    name: str | None = None


@dataclass(frozen=True)
class PrepareConfig:
    """What to prepare; paths may be None when tables are passed and returned."""

    attributes: dict[str, Attribute]
    cleaning: tuple[Step, ...] = ()
    transforming: tuple[Step, ...] = ()
    plotting: tuple[Step, ...] = ()
    preprocess: str | None = None
    raw_path: str | None = None
    clean_path: str | None = None
    plot_path: str | None = None

    @staticmethod
    def parse(source: dict | str) -> PrepareConfig:
        """From a dictionary, or from the path of a JSON file."""
        if isinstance(source, str):
            with open(source, encoding="utf-8") as file:
                source = json.load(file)

        def steps(section: str, action: str) -> tuple[Step, ...]:
            return tuple(
                Step(s["attribute"], s[action], tuple(s.get("args") or ()), dict(s.get("kwargs") or {}), s.get("name"))
                for s in source.get(section, ())
            )

        attributes = {
            name: Attribute(a["type"], a.get("rename"), tuple(a.get("missing_values") or ()))
            for name, a in source["attributes"].items()
        }
        return PrepareConfig(
            attributes,
            steps("cleaning", "missing_strategy"),
            steps("transforming", "action"),
            steps("plotting", "action"),
            source.get("preprocess_script_path"),
            source.get("raw_dataset_path"),
            source.get("clean_dataset_path"),
            source.get("plot_directory_path"),
        )


# Names usable in a config. A function takes (df, column, *args, **kwargs) and
# returns the column that replaces the old one, or a whole new table.
PREPROCESSORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "preprocess_books": recipes.preprocess_books,
    "preprocess_movies": recipes.preprocess_movies,
    "preprocess_music": recipes.preprocess_music,
}
CLEANERS: dict[str, Callable[..., Column | DataFrame]] = {
    "remove": drop_missing,
    "replace_missing_with_value": missing.replace_missing_with_value,
    "replace_missing_with_mode": missing.replace_missing_with_mode,
    "replace_missing_with_mean": missing.replace_missing_with_mean,
    "replace_missing_with_median": missing.replace_missing_with_median,
}
TRANSFORMS: dict[str, Callable[..., Column | DataFrame]] = {
    "z_score_norm": scaling.z_score_norm,
    "min_max_norm": scaling.min_max_norm,
    "merge_uncommon": categories.merge_uncommon,
    "make_named_bins": binning.make_named_bins,
    "make_mean_bins": binning.make_mean_bins,
    "make_median_bins": binning.make_median_bins,
    "make_min_bins": binning.make_min_bins,
    "make_max_bins": binning.make_max_bins,
}
PROFILES: dict[str, Callable[..., DataFrame]] = {
    "make_density_plot": profile.make_density_plot,
    "make_boxplot": profile.make_boxplot,
    "make_barplot": profile.make_barplot,
    "make_word_cloud": profile.make_word_cloud,
}


# Steps that read and replace nothing but their own column.
OWN_COLUMN = {
    *(CLEANERS[name] for name in CLEANERS if name != "remove"),
    *(TRANSFORMS[name] for name in TRANSFORMS if name != "merge_uncommon"),
}


def _named(registry: dict, name: str) -> Callable:
    if name not in registry:
        raise ValueError(f"unknown step {name!r}; known: {sorted(registry)}")
    return registry[name]


def fix_missing(df: DataFrame, column: str, strategy: str, args=()) -> DataFrame:
    """Repair (or drop) missing values of one column by a named strategy."""
    return run_steps(df, [Step(column, strategy, tuple(args or ()))], CLEANERS)


def transform_feature(df: DataFrame, column: str, action: str, args=(), kwargs=None) -> DataFrame:
    """Replace one column by its named transform."""
    return run_steps(df, [Step(column, action, tuple(args), dict(kwargs or {}))], TRANSFORMS)


def make_plot(df: DataFrame, column: str, action: str, args=(), kwargs=None) -> DataFrame:
    """The relation behind a named plot of one column."""
    return _named(PROFILES, action)(df, column, *args, **(kwargs or {}))


def run_steps(df: DataFrame, steps, registry: dict) -> DataFrame:
    """Apply steps in order.

    Neighbouring steps that read and replace different columns see the same
    table, so they become one projection and Catalyst merges their statistics
    into one aggregate. Any other step starts from the result so far.
    """
    pending: dict[str, Column] = {}
    for step in steps:
        operator = _named(registry, step.action)
        if pending and (operator not in OWN_COLUMN or step.attribute in pending):
            df, pending = df.withColumns(pending), {}
        require_columns(df, [step.attribute])
        result = operator(df, step.attribute, *step.args, **step.kwargs)
        if not isinstance(result, Column):
            df = result
        elif operator in OWN_COLUMN:
            pending[step.attribute] = result
        else:
            df = df.withColumn(step.attribute, result)
    return df.withColumns(pending) if pending else df


def load_data(spark: SparkSession, config: PrepareConfig, table: DataFrame | None = None) -> DataFrame:
    """The raw table: scanned, reshaped, sentinels blanked, cast to declared types, renamed."""
    df = scan_parquet(spark, config.raw_path) if table is None else table
    if config.preprocess is not None:
        df = _named(PREPROCESSORS, config.preprocess)(df)
    require_columns(df, config.attributes)
    df = missing.blank_sentinels(df, {n: list(a.missing_values) for n, a in config.attributes.items()})
    df = nan_to_null(cast_declared(df, {name: a.type for name, a in config.attributes.items()}))
    return df.withColumnsRenamed({n: a.rename for n, a in config.attributes.items() if a.rename})


def prepare(
    spark: SparkSession, config: PrepareConfig | dict | str, table: DataFrame | None = None, stage: bool | None = None
) -> DataFrame:
    """Run a preparation and return the prepared table.

    Fitting the steps reads the loaded table several times. ``stage`` computes
    it once before that; by default this is done after a preprocessor, which
    may shuffle, and not for a plain scan.
    """
    config = config if isinstance(config, PrepareConfig) else PrepareConfig.parse(config)
    df = load_data(spark, config, table)
    if config.preprocess is not None if stage is None else stage:
        df = staged(df, "loaded")
    return run_steps(run_steps(df, config.cleaning, CLEANERS), config.transforming, TRANSFORMS)


def profiles(df: DataFrame, config: PrepareConfig) -> dict[str, DataFrame]:
    """The configured profile relations of a prepared table, by name."""
    return {
        step.name or f"{step.action}_{step.attribute}": make_plot(
            df, step.attribute, step.action, step.args, step.kwargs
        )
        for step in config.plotting
    }


def run_pipeline(spark: SparkSession, config: PrepareConfig | dict | str) -> DataFrame:
    """Prepare, save, and write every configured profile; returns the saved table."""
    config = config if isinstance(config, PrepareConfig) else PrepareConfig.parse(config)
    save_parquet(prepare(spark, config), config.clean_path)
    saved = scan_parquet(spark, config.clean_path)
    for name, relation in profiles(saved, config).items():
        save_parquet(relation, f"{config.plot_path}/{name}")
    return saved

"""Command line: run a folder, or list what is known."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from . import config as settings
from . import tools
from .pipeline import Pipeline

_VALUES = {
    "input": "input_dir", "output": "output_dir", "engines": "engines", "vlm_model": "vlm_model", "vlm_agreement": "vlm_agreement_threshold", "budget": "budget_cap_usd", "column_layout": "column_layout",
    "langs": "languages", "dpi": "render_dpi", "workers": "max_workers", "marker_concurrency": "marker_concurrency", "max_retries": "max_retries", "retry_base_delay": "retry_base_delay_sec",
    "retry_max_delay": "retry_max_delay_sec", "timeout": "api_timeout_sec", "input_extensions": "input_extensions", "formats": "output_formats",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description="Transcribe a folder of documents.")
    p.add_argument("--input", "-i")
    p.add_argument("--output", "-o")
    p.add_argument("--config", "-c", help="YAML settings")
    p.add_argument("--profile")
    for name in _VALUES:
        if name not in ("input", "output"):
            p.add_argument("--" + name.replace("_", "-"))
    for flag in ("no-vlm", "no-postprocess", "test", "dry-run", "list-profiles", "list-engines", "list-languages", "verbose"):
        p.add_argument("--" + flag, action="store_true")
    p.add_argument("--list-languages-for", metavar="ENGINE")
    return p


def build_config(args: argparse.Namespace) -> settings.Config:
    """Arguments over the profile, over YAML, over the environment, over defaults."""
    c = settings.from_env()
    if args.config:
        c = settings.from_yaml(args.config, c)
    given = {f: getattr(args, a) for a, f in _VALUES.items() if getattr(args, a) is not None}
    if args.profile:
        c = settings.with_profile(c, args.profile, given=set(given))
    c = settings.with_values(c, given)
    off = {k: False for k, on in (("vlm_enabled", args.no_vlm), ("postprocess_enabled", args.no_postprocess)) if on}
    return replace(c, **off, test_mode=args.test or c.test_mode)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    listing = (
        (args.list_profiles, lambda: tools.profiles(spark)), (args.list_engines, lambda: tools.engines(spark)), (args.list_languages, lambda: tools.languages(spark)),
        (args.list_languages_for, lambda: tools.languages(spark, args.list_languages_for)),
    )
    for wanted, view in listing:
        if wanted:
            view().show(1000, truncate=False)
            return 0
    c = build_config(args)
    if args.dry_run:
        tools.dry_run(spark, c.input_dir, list(c.input_extensions)).show(10_000, truncate=False)
        return 0
    for k, v in Pipeline(spark, c).run().items():
        print(f"{k}: {v}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""What to scan and how: the one configuration record of the engine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from termscan.functions.paths import expand_env, normalize_extensions
from termscan.functions.patterns import is_blank, usable_pattern

# Tier thresholds used when none, or a non-positive one, is given.
DEFAULT_CREST = 0.90
DEFAULT_SLOPES = 0.60


class SpecError(ValueError):
    """A scan specification that cannot be run."""


@dataclass(frozen=True)
class ScanSpec:
    include_paths: Sequence[str] = ()
    extensions: Sequence[str] = ()
    anchor_terms: Sequence[str] = ()
    exclude_dir_regex: str | None = None
    exclude_file_regex: str | None = None
    prune_dir_regex: str | None = None
    exclusion_patterns: Sequence[str] = ()
    exclusion_files: Sequence[str] = ()
    planned_hints_regex: str | None = None
    code_hints_regex: str | None = None
    crest_threshold: float = DEFAULT_CREST
    slopes_threshold: float = DEFAULT_SLOPES
    max_file_mb: int = 0
    longest_text_bytes: int = 0  # longer files are reported as skipped; 0: no limit
    piece_bytes: int = 32 * 1024 * 1024  # a longer file of a tree is read in pieces of about this size
    output_dir: str | None = None
    dedupe: bool = True
    include_hidden: bool = True
    ignore_file_name: str = ".scanignore"
    skip_dirs: Sequence[str] = ()  # further output directories
    any_case_groups: bool = False  # count buckets and repositories that differ in case as one
    search: str = "each"  # or "layers", see operators/matching.py

    @classmethod
    def from_mapping(cls, raw: Mapping[str, object]) -> ScanSpec:
        """Normalised spec from plain configuration values; unknown keys are ignored."""
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__ and v is not None}
        return cls(**known).normalized()

    def normalized(self) -> ScanSpec:
        def blank_to_none(value: str | None) -> str | None:
            return None if is_blank(value) else value

        def filled(values: Sequence[str]) -> list[str]:
            return [v for v in values if not is_blank(v)]

        return replace(
            self,
            include_paths=[expand_env(p) for p in filled(self.include_paths)],
            extensions=normalize_extensions(self.extensions),
            anchor_terms=filled(self.anchor_terms),
            exclude_dir_regex=blank_to_none(self.exclude_dir_regex),
            exclude_file_regex=blank_to_none(self.exclude_file_regex),
            prune_dir_regex=blank_to_none(self.prune_dir_regex),
            exclusion_patterns=list(self.exclusion_patterns),
            skip_dirs=filled(self.skip_dirs),
            exclusion_files=[expand_env(p) for p in filled(self.exclusion_files)],
            planned_hints_regex=blank_to_none(self.planned_hints_regex),
            code_hints_regex=blank_to_none(self.code_hints_regex),
            crest_threshold=self.crest_threshold if self.crest_threshold > 0 else DEFAULT_CREST,
            slopes_threshold=self.slopes_threshold if self.slopes_threshold > 0 else DEFAULT_SLOPES,
            max_file_mb=max(self.max_file_mb, 0),
            longest_text_bytes=max(self.longest_text_bytes, 0),
            piece_bytes=max(self.piece_bytes, 1),
            output_dir=blank_to_none(self.output_dir),
        )

    def validate(self, spark: SparkSession | None = None) -> ScanSpec:
        """Raise :class:`SpecError` on the first problem, else return self.

        With a session the regexes are compiled too.
        """
        for name in ("include_paths", "extensions", "anchor_terms"):
            if not any(not is_blank(v) for v in getattr(self, name)):
                raise SpecError(f"{name} is empty")
        if not 0 < self.crest_threshold <= 1:
            raise SpecError(f"crest_threshold must be in (0, 1]: {self.crest_threshold}")
        if not 0 <= self.slopes_threshold < self.crest_threshold:
            raise SpecError(f"slopes_threshold must be in [0, crest_threshold): {self.slopes_threshold}")
        if spark is not None:
            for name in ("exclude_dir_regex", "exclude_file_regex", "prune_dir_regex",
                         "planned_hints_regex", "code_hints_regex"):
                pattern = getattr(self, name)
                if not is_blank(pattern) and usable_pattern(spark, pattern) is None:
                    raise SpecError(f"{name} is not a valid pattern: {pattern}")
        return self

"""Configuration of runs: typed sections, unknown keys refused, dotted overrides on a copy, all errors at once."""

from __future__ import annotations

import copy
import dataclasses
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class CleaningConfig:
    layout: str = "auto"
    pattern: str = "*.parquet"
    leakage_policy: str = "test-priority"
    dedupe_by: str = "pair"
    min_article_words: int = 10
    min_summary_words: int = 3
    max_summary_ratio: float = 1.0
    near_duplicate_threshold: float = 0.0
    remove_repeated_sentences: bool = False
    min_repeated_sentence_chars: int = 30
    train_ratio: float = 0.8
    validation_ratio: float = 0.1
    output_format: str = "auto"
    audit_only: bool = False

    def problems(self) -> list[str]:
        out = []
        if self.layout not in ("auto", "split", "original"):
            out.append("cleaning.layout must be auto, split or original")
        if self.leakage_policy not in ("test-priority", "train-priority", "resplit", "error"):
            out.append("cleaning.leakage_policy must be test-priority, train-priority, resplit or error")
        if self.dedupe_by not in ("pair", "article"):
            out.append("cleaning.dedupe_by must be pair or article")
        if self.output_format not in ("auto", "csv", "parquet"):
            out.append("cleaning.output_format must be auto, csv or parquet")
        if self.near_duplicate_threshold != 0 and not 0.5 <= self.near_duplicate_threshold <= 1:
            out.append("cleaning.near_duplicate_threshold must be 0 or from 0.5 to 1")
        if min(self.min_article_words, self.min_summary_words) < 0 or self.max_summary_ratio <= 0:
            out.append("cleaning word minima must not be negative and the ratio must be above 0")
        if not (0 < self.train_ratio and 0 < self.validation_ratio and self.train_ratio + self.validation_ratio < 1):
            out.append("cleaning ratios must leave room for a test split")
        return out


@dataclass
class DataConfig:
    train_file: str = ""
    valid_file: str = ""
    test_file: str = ""
    source_prefix: str = "summarize: "
    max_source_length: int = 768
    max_target_length: int = 160
    max_train_samples: int | None = None
    max_eval_samples: int | None = None

    def problems(self) -> list[str]:
        out = [f"data.{k} must be above 0" for k in ("max_source_length", "max_target_length") if getattr(self, k) < 1]
        caps = [f"data.{k} must not be negative" for k in ("max_train_samples", "max_eval_samples") if (getattr(self, k) or 0) < 0]
        return out + caps


@dataclass
class EvaluationConfig:
    vocabulary: int = 384
    pad_token: int = 0
    batch_size: int = 8

    def problems(self) -> list[str]:
        return [f"evaluation.{k} must be above 0" for k in ("vocabulary", "batch_size") if getattr(self, k) < 1]


@dataclass
class ModelConfig:
    """name: ``lead:N`` for the first N words, or ``package.module:function``, which is called with the decoding options."""

    name: str = "lead:20"

    def problems(self) -> list[str]:
        return [] if ":" in self.name else ["model.name must be lead:N or module:function"]


@dataclass
class GenerationConfig:
    num_beams: int = 4
    max_length: int = 200
    min_length: int = 30
    repetition_penalty: float = 1.05
    length_penalty: float = 1.0
    no_repeat_ngram_size: int = 3

    def problems(self) -> list[str]:
        out = [f"generation.{k} must be above 0" for k in ("num_beams", "max_length") if getattr(self, k) < 1]
        return out + (["generation.min_length must not exceed max_length"] if self.min_length > self.max_length else [])


@dataclass
class Config:
    cleaning: CleaningConfig = field(default_factory=CleaningConfig)
    data: DataConfig = field(default_factory=DataConfig)
    evaluation: EvaluationConfig = field(default_factory=EvaluationConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    generation: GenerationConfig = field(default_factory=GenerationConfig)

    def problems(self) -> list[str]:
        return [p for f in dataclasses.fields(self) for p in getattr(self, f.name).problems()]


def _coerce(value: Any, kind: Any, name: str) -> Any:
    options = typing.get_args(kind) if isinstance(kind, types.UnionType) else (kind,)
    if value is None:
        if type(None) in options:
            return None
        raise ValueError(f"{name} must not be null")
    kind = next(o for o in options if o is not type(None))
    if kind is bool:
        if isinstance(value, bool):
            return value
        if str(value).strip().lower() in ("true", "false"):
            return str(value).strip().lower() == "true"
        raise ValueError(f"{name} must be true or false")
    if isinstance(value, bool):
        raise ValueError(f"{name} must be of {kind.__name__}")
    try:
        return kind(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be of {kind.__name__}") from None


def build(data: dict[str, Any]) -> Config:
    """A validated configuration from nested dictionaries."""
    config, errors = Config(), []
    sections = typing.get_type_hints(Config)
    for section, values in (data or {}).items():
        if section not in sections:
            errors.append(f"unknown section {section}")
            continue
        kinds = typing.get_type_hints(sections[section])
        for key, value in (values or {}).items():
            if key not in kinds:
                errors.append(f"unknown key {section}.{key}")
                continue
            try:
                setattr(getattr(config, section), key, _coerce(value, kinds[key], f"{section}.{key}"))
            except ValueError as error:
                errors.append(str(error))
    errors += config.problems()
    if errors:
        raise ValueError("; ".join(errors))
    return config


def load(path: str) -> Config:
    """From a YAML or JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        import json

        data = json.loads(text)
    return build(data or {})


def override(config: Config, changes: dict[str, Any]) -> Config:
    """A changed copy; keys are dotted, as in cleaning.dedupe_by."""
    data = copy.deepcopy(dataclasses.asdict(config))
    for dotted, value in changes.items():
        section, _, key = dotted.partition(".")
        if section not in data or key not in data[section]:
            raise ValueError(f"unknown key {dotted}")
        data[section][key] = value
    return build(data)


def to_dict(config: Config) -> dict[str, Any]:
    return dataclasses.asdict(config)

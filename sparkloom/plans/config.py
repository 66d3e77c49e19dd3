"""Driver-side configuration: models, sampling, prompts, rubrics; hashes of each."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any

from sparkloom.sources.tables import digest

STAGE_KINDS = frozenset("vlm_caption vlm_tags text_label text_extract rubric_score embed_text embed_mm rerank synth_text synth_vlm filter transform".split())
SYNTH_KINDS = frozenset("qa instruction paraphrase conversation caption summary".split())


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in [{low}, {high}]")


@dataclass(frozen=True)
class Sampling:
    temperature: float = 0.0
    top_p: float = 1.0
    max_tokens: int = 512
    presence_penalty: float = 0.0
    frequency_penalty: float = 0.0
    seed: int | None = None
    stop: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _within("temperature", self.temperature, 0, 2)
        _within("top_p", self.top_p, 0, 1)
        _within("presence_penalty", self.presence_penalty, -2, 2)
        _within("frequency_penalty", self.frequency_penalty, -2, 2)

    def params(self) -> dict[str, Any]:
        """What differs from the defaults."""
        return {f.name: getattr(self, f.name) for f in dataclasses.fields(self) if getattr(self, f.name) != f.default}

    def hash(self) -> str:
        return digest(dataclasses.asdict(self))


@dataclass(frozen=True)
class Model:
    name: str
    task: str = "generate"
    revision: str | None = None
    quantization: str | None = None
    dtype: str = "auto"
    batch_size: int = 64
    concurrency: int = 1
    engine: tuple[tuple[str, Any], ...] = ()

    def hash(self) -> str:
        """How a model is run (batch size, concurrency) is not part of what it is."""
        return digest({k: v for k, v in dataclasses.asdict(self).items() if k not in ("batch_size", "concurrency")})


@dataclass(frozen=True)
class Criterion:
    name: str
    description: str = ""
    weight: float = 1.0
    low: float = 0.0
    high: float = 10.0


@dataclass(frozen=True)
class Rubric:
    name: str
    criteria: tuple[Criterion, ...]

    def weights(self) -> dict[str, float]:
        return {c.name: c.weight for c in self.criteria}

    def hash(self) -> str:
        return digest(dataclasses.asdict(self))


@dataclass(frozen=True)
class Prompt:
    name: str
    template: str
    system: str | None = None
    shots: tuple[tuple[str, str], ...] = ()
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    def hash(self) -> str:
        return digest(dataclasses.asdict(self))

    def problems(self) -> list[str]:
        """What a lint finds: empty parts, required names that the template doesn't use."""
        out = [] if self.template.strip() else ["the template is empty"]
        if self.system is not None and not self.system.strip():
            out.append("the system message is empty")
        return out + [f"{n} is not in the template" for n in self.required if "{" + n + "}" not in self.template]


@dataclass
class PromptPack:
    name: str
    version: str
    prompts: dict[str, Prompt] = field(default_factory=dict)
    rubrics: dict[str, Rubric] = field(default_factory=dict)

    def resolve(self, prompt: str, version: str | None = None) -> Prompt:
        if version is not None and version != self.version:
            raise ValueError(f"pack {self.name} has version {self.version}, not {version}")
        if prompt not in self.prompts:
            raise KeyError(prompt)
        return self.prompts[prompt]

    def hash(self) -> str:
        return digest(dataclasses.asdict(self))

    def save(self, path: str) -> None:
        import yaml

        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(_plain(dataclasses.asdict(self)), f, sort_keys=True, allow_unicode=True)

    @staticmethod
    def load(path: str) -> PromptPack:
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f)
        prompts = {k: Prompt(**v | {"shots": tuple(tuple(s) for s in v.get("shots", ())), "required": tuple(v.get("required", ())), "optional": tuple(v.get("optional", ()))}) for k, v in (raw.get("prompts") or {}).items()}
        rubrics = {k: Rubric(v["name"], tuple(Criterion(**c) for c in v["criteria"])) for k, v in (raw.get("rubrics") or {}).items()}
        return PromptPack(raw["name"], str(raw["version"]), prompts, rubrics)


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def combined_fingerprint(**hashes: str | None) -> str:
    """One hash of named parts, by name."""
    return digest({k: v or "" for k, v in hashes.items()})

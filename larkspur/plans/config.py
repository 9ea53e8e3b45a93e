"""Settings: defaults, a YAML file, and dotted keys to read and set them by."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

import yaml

from larkspur.plans.sinks import masked


@dataclass
class Embedding:
    url: str = "https://api.openai.com/v1"
    api_key: str = ""
    model: str = "text-embedding-3-small"
    max_batch: int = 0


@dataclass
class Chunking:
    max_tokens: int = 512
    overlap: int = 100


@dataclass
class Storage:
    path: str = str(Path.home() / ".local" / "share" / "larkspur")


@dataclass
class Reranker:
    enabled: bool = False
    url: str = ""
    api_key: str = ""
    model: str = ""


@dataclass
class Corrective:
    enabled: bool = False
    evaluator_url: str = ""
    api_key: str = ""
    model: str = ""
    web_search_url: str = ""


@dataclass
class QueryRewrite:
    enabled: bool = False
    max_queries: int = 3
    url: str = ""
    api_key: str = ""
    model: str = ""


@dataclass
class Llm:
    url: str = "https://api.openai.com/v1"
    api_key: str = ""
    model: str = "gpt-3.5-turbo"


@dataclass
class GraphRag:
    enabled: bool = False
    max_hops: int = 2
    top_k: int = 5


@dataclass
class HierarchicalIndex:
    enabled: bool = False
    max_summary_length: int = 500
    max_paragraph_length: int = 2000
    max_sentence_length: int = 200


@dataclass
class Config:
    """All settings. In dotted keys dashes stand for underscores: ``query-rewrite.max-queries``."""

    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    storage: Storage = field(default_factory=Storage)
    reranker: Reranker = field(default_factory=Reranker)
    corrective: Corrective = field(default_factory=Corrective)
    query_rewrite: QueryRewrite = field(default_factory=QueryRewrite)
    llm: Llm = field(default_factory=Llm)
    graph_rag: GraphRag = field(default_factory=GraphRag)
    hierarchical_index: HierarchicalIndex = field(default_factory=HierarchicalIndex)

    def _place(self, key: str) -> tuple[object, str]:
        section, _, name = key.replace("-", "_").partition(".")
        part = getattr(self, section, None)
        if part is None or name not in {f.name for f in fields(part)}:
            raise KeyError(f"unknown config key: {key}")
        return part, name

    def get(self, key: str) -> str:
        value = getattr(*self._place(key))
        return str(value).lower() if isinstance(value, bool) else str(value)

    def display(self, key: str) -> str:
        """Like get(), with secrets masked."""
        return masked(self.get(key)) if key.replace("-", "_").endswith("api_key") else self.get(key)

    def set(self, key: str, value: str) -> None:
        """A number that isn't one or isn't positive leaves the setting as it is."""
        part, name = self._place(key)
        old = getattr(part, name)
        if isinstance(old, bool):
            setattr(part, name, value.strip().lower() in ("true", "1", "yes", "on"))
        elif isinstance(old, int):
            setattr(part, name, int(value) if value.strip().isdigit() and int(value) > 0 else old)
        else:
            setattr(part, name, value)

    def keys(self) -> list[str]:
        return [f"{s.name}.{f.name}".replace("_", "-") for s in fields(self) for f in fields(getattr(self, s.name))]


def default_path() -> Path:
    return Path.home() / ".larkspur" / "config.yml"


def load(path: Path | None = None, legacy: Path | None = None) -> Config:
    """Settings of a file over the defaults; an older file is copied to the new place once. Unknown keys don't matter."""
    path = path or default_path()
    if not path.exists() and legacy and legacy.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(legacy.read_bytes())
    config = Config()
    if path.exists():
        for section, values in (yaml.safe_load(path.read_text()) or {}).items():
            part = getattr(config, section, None)
            known = {f.name for f in fields(part)} if part is not None else set()
            for name, value in (values or {}).items():
                if name in known and value is not None:
                    setattr(part, name, value)
    return config


def save(config: Config, path: Path | None = None) -> None:
    path = path or default_path()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(asdict(config), sort_keys=False, allow_unicode=True))
    path.chmod(0o600)

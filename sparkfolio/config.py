"""Settings: defaults, then the first settings file found, then the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

PREFIX = "SPARKFOLIO_"


@dataclass
class Config:
    data_dir: str = "data"
    embed_url: str = "http://localhost:8080/embedding"
    embed_health_url: str = ""
    embed_dimensions: int = 1024
    llm_url: str = "http://localhost:8081/v1/chat/completions"
    llm_model: str = ""
    chunk_size: int = 800
    chunk_overlap: int = 200
    max_distance: float = 0.94
    search_limit: int = 10
    source: str = field(default="defaults")

    def __post_init__(self):
        if not self.embed_health_url:
            self.embed_health_url = health_url(self.embed_url)


def health_url(url: str) -> str:
    """The service's ``health`` beside the last part of its path."""
    return url.rsplit("/", 1)[0] + "/health"


def candidates() -> list[Path]:
    named = os.environ.get(PREFIX + "CONFIG")
    home = Path.home()
    places = [Path("sparkfolio.toml"), Path("config.toml"), home / ".config/sparkfolio/config.toml", home / ".sparkfolio.toml", Path("/etc/sparkfolio.toml")]
    return [Path(named), *places] if named else places


def find_config_file() -> Path | None:
    return next((p for p in candidates() if p.is_file()), None)


def load_config() -> Config:
    values: dict = {}
    found = find_config_file()
    if found:
        for key, value in tomllib.loads(found.read_text()).items():
            values |= {f"{key}_{k}": v for k, v in value.items()} if isinstance(value, dict) else {key: value}
        values = {k.removeprefix("general_"): v for k, v in values.items()}
        values["source"] = str(found)
    out = {}
    for f in fields(Config):
        given = os.environ.get(PREFIX + f.name.upper(), values.get(f.name))
        if given is not None:
            out[f.name] = type(f.default)(given)
    return Config(**out)

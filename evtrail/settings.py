"""An analyst's settings: a TOML file of a few strings, and where the case store is (survey A22)."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from .schema import SEVERITIES

#: What a settings file may hold.
KEYS = ("state_dir", "default_severity", "analyst_name")
FILE, FOLDER, VARIABLE = "config.toml", ".evtrail", "EVTRAIL_STATE"


class SettingsError(ValueError):
    """A settings file that can't be used, by name and key."""


@dataclass
class Settings:
    source: str | None = None
    state_dir: str | None = None
    default_severity: str | None = None
    analyst_name: str | None = None
    warnings: list[str] = field(default_factory=list)

    def as_dict(self) -> dict[str, object]:
        return asdict(self)


def load(path: str | None = None) -> Settings:
    """The settings of path, or of the home folder's file if there is one. Unknown keys are warnings, wrong values errors."""
    file = Path(path).expanduser() if path else Path.home() / FOLDER / FILE
    if not file.is_file():
        if path:
            raise SettingsError(f"no settings file {path}")
        return Settings()
    try:
        given = tomllib.loads(file.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as fault:
        raise SettingsError(f"{file}: {fault}") from fault
    out = Settings(str(file))
    for key, value in given.items():
        if not isinstance(value, str):
            raise SettingsError(f"{file}: {key} must be a string")
        if key not in KEYS:
            out.warnings.append(f"unknown key {key}")
            continue
        if key == "default_severity" and (value := value.lower()) not in SEVERITIES:
            raise SettingsError(f"{file}: {key} must be one of {', '.join(SEVERITIES)}")
        setattr(out, key, value)
    return out


def state_folder(option: str | None, settings: Settings) -> str:
    """Where cases are: the option, else the environment, else the settings, else a folder in the home folder."""
    return option or os.environ.get(VARIABLE) or settings.state_dir or str(Path.home() / FOLDER)

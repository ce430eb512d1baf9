"""Settings of a run: keys of services from the environment, the rest by argument."""
from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """service_key: for the model service; none means that the offline stand-ins are used."""

    service_key: str | None = None
    models: tuple[str, ...] = ("small", "large")
    low_pairs: int = 300
    enough_pairs: int = 350

    @classmethod
    def from_env(cls, variable: str = "MODEL_SERVICE_KEY", **values) -> Settings:
        return cls(service_key=os.environ.get(variable) or None, **values)

    @property
    def offline(self) -> bool:
        return self.service_key is None

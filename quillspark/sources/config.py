"""Configuration files, on the driver: nested YAML, flattened for a run's record."""

from typing import Any


def load_config(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def override(path: str, section: str, **values) -> dict[str, Any]:
    """Read, set keys of one section, write back."""
    import yaml

    config = load_config(path)
    config.setdefault(section, {}).update(values)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(config, f, sort_keys=False, allow_unicode=True)
    return config

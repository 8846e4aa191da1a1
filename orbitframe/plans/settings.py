"""Layered settings: defaults, a config, and command line values."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import Column, DataFrame, functions as F

#: The keys and their defaults.
DEFAULTS = {
    "is_360": True, "resolution": 2048, "fov": 90, "camera_count": 6, "pitch_offset": 0, "layout_mode": "ring",
    "ai_mode": "None", "ai_confidence": 0.25, "ai_invert_mask": True, "ai_detect_humans": True, "ai_detect_vehicles": False, "ai_detect_plants": False,
    "ai_custom_classes": "", "ai_mask_cameras": [], "quality": 95, "output_format": "jpg", "custom_output_dir": "",
    "interval_value": 1.0, "interval_unit": "Seconds", "blur_filter_enabled": False, "smart_blur_enabled": False, "blur_threshold": 100.0,
    "sharpening_enabled": False, "sharpening_strength": 0.5, "adaptive_mode": False, "adaptive_threshold": 0.5, "export_telemetry": False,
    "altitude_mode": "absolute", "interpolation_mode": "linear", "feather_mask": False,
    "naming_mode": "realityscan", "image_pattern": "{filename}_frame{frame}_{camera}", "mask_pattern": "{filename}_frame{frame}_{camera}_mask",
}
ALIASES = {"interval": "interval_value", "format": "output_format", "layout": "layout_mode", "custom_classes": "ai_custom_classes"}
AI_NONE, AI_SKIP, AI_MASK = "None", "Skip Frame", "Generate Mask"

#: What a value given on the command line entails besides itself.
ENTAILED = {
    "flat": {"is_360": False}, "adaptive": {"adaptive_mode": True}, "export_telemetry": {"export_telemetry": True}, "interval_value": {"interval_unit": "Seconds"},
}
#: Where the AI mode comes from, first wins: a layer, its key, and the mode if that is a flag (None: the value is the mode).
AI_SOURCES = (("given", "ai_skip", AI_SKIP), ("given", "ai_mask", AI_MASK), ("given", "ai", AI_MASK), ("config", "ai_mode", None), ("config", "ai", AI_MASK))
TARGETS = ("humans", "vehicles", "plants")


def _named(layer: dict, names: dict[str, str]) -> dict:
    """A layer without nulls and with full names, which win over short ones."""
    layer = {k: v for k, v in layer.items() if v is not None}
    return {names[k]: v for k, v in layer.items() if k in names} | {k: v for k, v in layer.items() if k not in names}


def resolved(config: dict, cli: dict) -> dict:
    """The settings of a run: command line values over the config over the defaults; nulls say nothing.

    Short names stand for the full ones (ALIASES). Values may entail others (ENTAILED); flags only switch on. The AI
    mode is that of the first source that has one (AI_SOURCES). Targets on the command line set all three
    detection flags, and a pattern without a mode means custom names.
    """
    config, given = _named(config, ALIASES), _named(cli, ALIASES | {"motion_threshold": "adaptive_threshold"})
    layers = {"given": given, "config": config}
    out = DEFAULTS | {k: v for layer in (config, given) for k, v in layer.items() if k in DEFAULTS and not (layer is given and k in ENTAILED and isinstance(v, bool))}
    for key, more in ENTAILED.items():
        out |= more if key in given and given[key] is not False else {}
    found = (mode or layers[layer][key] for layer, key, mode in AI_SOURCES if layers[layer].get(key) not in (None, False, AI_NONE))
    out["ai_mode"] = next(found, AI_NONE)
    if "targets" in given:
        chosen = {x.strip().lower() for x in given["targets"].split(",")}
        out |= {f"ai_detect_{k}": k in chosen for k in TARGETS}
    if "naming_mode" not in given and given.keys() & {"image_pattern", "mask_pattern"}:
        out["naming_mode"] = "custom"
    if cameras := [x["active_cameras"] for x in (given, config) if "active_cameras" in x]:
        out["active_cameras"] = cameras[0]
    if isinstance(out["ai_mask_cameras"], str):
        out["ai_mask_cameras"] = [x.strip() for x in out["ai_mask_cameras"].split(",") if x.strip()]
    return out


def load_config(path: str | None) -> dict:
    """A JSON object of settings; ValueError if it can't be read."""
    if not path:
        return {}
    with open(path) as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError("the config isn't a JSON object")
    return found


def load_saved(path: str) -> dict:
    """Saved settings over the defaults; the defaults alone where the file is missing or broken."""
    try:
        return dict(DEFAULTS) | load_config(path)
    except (OSError, ValueError):
        return dict(DEFAULTS)


def save(path: str, settings: dict) -> None:
    with open(path, "w") as f:
        json.dump(settings, f, indent=4)


def arguments() -> argparse.ArgumentParser:
    """The command line of the extraction."""
    p = argparse.ArgumentParser(prog="orbitframe", description="Extract views from panoramic and flat frames with Spark.")
    for name in ("input", "output", "config", "layout", "format", "active-cameras", "targets", "image-pattern", "mask-pattern", "ai-mask-cameras", "custom-classes", "altitude-mode", "detections", "detector"):
        p.add_argument(f"--{name}")
    p.add_argument("--naming-mode", choices=("realityscan", "simple", "custom"))
    for name in ("resolution", "camera-count", "quality"):
        p.add_argument(f"--{name}", type=int)
    for name in ("interval", "motion-threshold"):
        p.add_argument(f"--{name}", type=float)
    for name in ("flat", "ai", "ai-mask", "ai-skip", "adaptive", "export-telemetry"):
        p.add_argument(f"--{name}", action="store_const", const=True)
    return p


def merged_columns(rows: DataFrame, keys: dict[str, tuple]) -> DataFrame:
    """rows with ``key = coalesce(cli_key, config_key, default)`` for keys: {key: (cli column, config column, default)}."""
    return rows.withColumns({k: F.coalesce(F.col(cli), F.col(config), F.lit(default)) for k, (cli, config, default) in keys.items()})


def ai_mode_column(skip: Column, mask: Column, config_mode: Column, legacy: Column) -> Column:
    """The AI mode of each row by AI_SOURCES; mask stands for both of its flags."""
    columns = {("given", "ai_skip"): skip, ("given", "ai_mask"): mask, ("config", "ai_mode"): config_mode, ("config", "ai"): legacy}
    found = [F.when(columns[x[:2]], x[2]) if x[2] else F.nullif(columns[x[:2]], F.lit(AI_NONE)) for x in AI_SOURCES if x[:2] in columns]
    return F.coalesce(*found, F.lit(AI_NONE))


def interval_columns(given: Column, value: Column, alias: Column, unit: Column) -> tuple[Column, Column]:
    """(value, unit) of each row: an interval on the command line counts seconds; else the config's value, under its full name or its alias, and unit."""
    own = F.coalesce(value.cast("double"), alias.cast("double"), F.lit(float(DEFAULTS["interval_value"])))
    return F.coalesce(given.cast("double"), own), F.when(given.isNotNull(), "Seconds").otherwise(F.coalesce(unit, F.lit(DEFAULTS["interval_unit"])))


def target_columns(given: Column, config: dict[str, Column]) -> dict[str, Column]:
    """The three detection flags of each row: targets on the command line set all of them, else those of the config, else the defaults."""
    chosen = F.transform(F.split(F.lower(given), ","), lambda x: F.trim(x))
    return {f"ai_detect_{k}": F.when(given.isNotNull(), F.array_contains(chosen, k)).otherwise(F.coalesce(config[k], F.lit(DEFAULTS[f"ai_detect_{k}"]))) for k in TARGETS}


def naming_column(mode: Column, image_pattern: Column, mask_pattern: Column, config_mode: Column) -> Column:
    """The naming mode of each row: that of the command line, custom if it has a pattern alone, else the config's, else the default."""
    patterned = F.when(image_pattern.isNotNull() | mask_pattern.isNotNull(), "custom")
    return F.coalesce(mode, patterned, config_mode, F.lit(DEFAULTS["naming_mode"]))


def switched_column(key: str, flag: Column, config: Column) -> Column:
    """The setting ``key`` of each row after the flag that entails it (ENTAILED), which only sets it: the config's value or the default stays without it."""
    (value,) = (more[key] for more in ENTAILED.values() if key in more)
    return F.when(flag, F.lit(value)).otherwise(F.coalesce(config, F.lit(DEFAULTS[key])))

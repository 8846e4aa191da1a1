"""File names, paths and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MODES = ("realityscan", "simple", "custom")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tiff", "tif")
VIDEO_SUFFIXES = ("mp4", "avi", "mov", "mkv")


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def stem(path: Column) -> Column:
    """File name without folder and last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case letters after the last dot of the file name."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def is_media(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES, *VIDEO_SUFFIXES)


def is_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def padded(frame: Column) -> Column:
    """Six digits, more if the number has more."""
    return F.format_string("%06d", frame.cast("long"))


def substituted(pattern, values: dict[str, Column]) -> Column:
    """The pattern with {key} replaced in the order of ``values``; a value's own {later key} is replaced too."""
    out = _lit(pattern)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return out


def output_names(mode: str, filename: Column, frame: Column, camera: Column, ext, image_pattern=None, mask_pattern=None) -> tuple[Column, Column]:
    """(image name, mask name) of a view; generated names keep only what follows the last slash.

    realityscan: the mask is the image with .mask.png. simple: it ends in _mask.png. custom: the patterns
    with {filename}, {frame}, {camera}, {ext}, in the mask's also {image_name}; the suffix is added
    where the pattern has no {ext}, for masks .png. Other modes are refused.
    """
    if mode not in MODES:
        raise ValueError(f"naming mode must be one of {MODES}")
    ext, number = _lit(ext), padded(frame)
    base = F.concat(filename, F.lit("_frame"), number, F.lit("_"), camera)
    if mode != "custom":
        image = F.concat(base, F.lit("."), ext)
        mask = F.concat(image, F.lit(".mask.png")) if mode == "realityscan" else F.concat(base, F.lit("_mask.png"))
        return basename(image), basename(mask)
    values = {"filename": filename, "frame": number, "camera": camera, "ext": ext}
    pattern = _lit(image_pattern)
    image = substituted(pattern, values)
    image = F.when(F.instr(pattern, "{ext}") > 0, image).otherwise(F.concat(image, F.lit("."), ext))
    pattern = _lit(mask_pattern)
    mask = substituted(pattern, values | {"image_name": image})
    mask = F.when(F.instr(pattern, "{ext}") > 0, mask).otherwise(F.concat(mask, F.lit(".png")))
    return basename(image), basename(mask)


def output_dir(path: Column, custom=None) -> Column:
    """<custom folder, else the source's>/<stem>_processed; a blank custom folder counts as none."""
    own = F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/+$", "")
    custom = _lit(custom).cast("string")
    folder = F.when(F.coalesce(F.trim(custom), F.lit("")) != "", F.regexp_replace(custom, "/+$", "")).otherwise(own)
    return F.concat(folder, F.lit("/"), stem(path), F.lit("_processed"))


def file_format(wanted) -> tuple[Column, Column]:
    """(format, suffix): jpg, png or tiff, anything else is jpg; tiff files end in tif."""
    w = F.lower(F.trim(_lit(wanted)))
    w = F.when(w.isin("jpg", "png", "tiff"), w).otherwise(F.lit("jpg"))
    return w, F.when(w == "tiff", "tif").otherwise(w)

"""Keys, file names and labels as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that are kept as they are, and the one used otherwise.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "webp")
DEFAULT_EXTENSION = "jpg"

# Key widths of the raw key file and of the exported list.
STORED_KEY_WIDTH = 24
EXPORTED_KEY_WIDTH = 32


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_key(raw: Column | str) -> Column:
    """Bytes of a fixed-width key as text: NUL padding stripped, UTF-8, and if that fails
    the bytes one by one as Latin-1 so that no key is lost."""
    raw = _c(raw)
    utf8 = F.try_validate_utf8(raw.cast("string"))
    text = F.coalesce(utf8, F.decode(raw, "ISO-8859-1"))
    return F.rtrim(text, F.lit("\u0000"))


def truncate_key(key: Column | str, width: int) -> Column:
    return F.substring(_c(key), 1, width)


def base_name(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def with_default_ext(name: Column | str, ext: str = ".jpg") -> Column:
    name = _c(name)
    return F.when(F.lower(name).endswith(ext), name).otherwise(F.concat(name, F.lit(ext)))


def output_name(
    item_id: Column | str, label: Column | str | None = None, pattern: str | None = None
) -> Column:
    """``image_{id}.jpg``, ``image_{id}_class{label}.jpg``, or ``pattern`` with ``{}``
    standing for the id."""
    item = _c(item_id).cast("string")
    if pattern is not None:
        head, sep, tail = pattern.partition("{}")
        return F.concat(F.lit(head), item, F.lit(tail)) if sep else F.lit(pattern)
    plain = F.concat(F.lit("image_"), item, F.lit(".jpg"))
    if label is None:
        return plain
    label = _c(label).cast("string")
    labelled = F.concat(F.lit("image_"), item, F.lit("_class"), label, F.lit(".jpg"))
    return F.coalesce(labelled, plain)


def label_from_name(name: Column | str) -> Column:
    """1 if the name says ``class1``, else 0."""
    return F.when(_c(name).contains("class1"), 1).otherwise(0)


def normalize_ext(ext: Column | str) -> Column:
    ext = F.lower(_c(ext))
    return F.when(ext.isin(*IMAGE_EXTENSIONS), ext).otherwise(F.lit(DEFAULT_EXTENSION))


def eps_column(eps: float) -> str:
    """Name of the flag column of one eps: 0.05 → ``eps_0_05``."""
    return "eps_" + f"{float(eps)}".replace(".", "_").replace("-", "m")

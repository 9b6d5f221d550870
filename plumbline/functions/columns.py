"""Scalar column functions: angles, rigid transforms, tolerant parsing, names and keys."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_angle(a: Column, period: float) -> Column:
    """a in [-period/2, period/2)."""
    return F.pmod(a + period / 2, F.lit(period)) - period / 2


def clean_number(text: Column) -> Column:
    """A finite number from text, decimal comma allowed; blanks, words, NaN and infinities are null."""
    x = F.replace(F.trim(text.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def positive_number(text: Column) -> Column:
    """As clean_number, with zero and less counted as missing."""
    x = clean_number(text)
    return F.when(x > 0, x)


def natural_key(text: Column, width: int = 20) -> Column:
    """A string that sorts digits as numbers and letters without case: runs of digits are padded."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.regexp_replace(r, r"^0+(?=\d)", ""), width, "0")).otherwise(r)), "")


def surface_kind(surface_id: Column) -> Column:
    return F.when(surface_id.endswith("-FLOOR"), "floor").when(surface_id.endswith("-CEIL"), "ceiling").otherwise("wall")


def matmul(a: Column, b: Column, n: int) -> Column:
    """Product of two row-major n x n matrices held as arrays."""
    cell = lambda i, j: reduce(lambda x, y: x + y, [F.get(a, F.lit(i * n + k)) * F.get(b, F.lit(k * n + j)) for k in range(n)])
    return F.array(*(cell(i, j) for i in range(n) for j in range(n)))


def transform_point(t: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point moved by a row-major 4 x 4 transform."""
    row = lambda i: F.get(t, F.lit(4 * i)) * x + F.get(t, F.lit(4 * i + 1)) * y + F.get(t, F.lit(4 * i + 2)) * z + F.get(t, F.lit(4 * i + 3))
    return row(0), row(1), row(2)


def invert_rigid(t: Column) -> Column:
    """Inverse of a row-major rigid 4 x 4 transform."""
    r = lambda i, j: F.get(t, F.lit(4 * i + j))
    shift = [-(r(0, i) * r(0, 3) + r(1, i) * r(1, 3) + r(2, i) * r(2, 3)) for i in range(3)]
    rows = [[r(0, i), r(1, i), r(2, i), shift[i]] for i in range(3)]
    return F.array(*(c for row in rows for c in row), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Row-major 3 x 3 rotation of a quaternion, normalised first."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = x / n, y / n, z / n, w / n
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def y_up_to_z_up(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return x, -z, y


def scale_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, sx: Column, sy: Column) -> tuple[Column, Column, Column, Column]:
    """Pinhole intrinsics after an image is resized; pixel centres are at whole numbers."""
    return fx * sx, fy * sy, (cx + 0.5) * sx - 0.5, (cy + 0.5) * sy - 0.5


def focal_from_35mm(focal_35: Column, width: Column, height: Column) -> Column:
    """Focal length in pixels of a 35 mm equivalent, by the diagonal of the frame (43.2666 mm)."""
    return focal_35 * F.sqrt(width * width + height * height) / 43.26661530556787


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    long = F.greatest(dx * dx + dy * dy, F.lit(1e-18))
    t = F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / long, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


#: Metres in a unit, and the quantity units of reports.
METRES = {"m": 1.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "in": 0.0254}
SQUARE_FEET, FEET = 10.7639, 3.28084


def parse_quantity(text: Column, unit: Column | None = None) -> Column:
    """Metres of a length as people write it: 3.2 m, 320cm, 3,20 m, 1,234 mm, 10' 6\", 10 ft 6 in.

    A cell's own unit wins over the given one; without either it is metres.
    A comma with exactly three digits after it, and no point, divides
    thousands; any other comma is a decimal one.
    """
    s = F.regexp_replace(F.lower(F.trim(text)), "[′’]", "'")
    s = F.regexp_replace(s, "[″“”]", '"')
    feet = F.regexp_extract(s, r"^(-?\d+(?:[.,]\d+)?)\s*(?:'|ft|feet)", 1)
    inches = F.regexp_extract(s, r"(?:'|ft|feet)\s*(\d+(?:[.,]\d+)?)\s*(?:\"|in|inch|inches)?$", 1)
    number = F.regexp_extract(s, r"^(-?[\d.,]+)", 1)
    number = F.when(number.rlike(r"^-?\d{1,3}(,\d{3})+$"), F.replace(number, F.lit(","), F.lit(""))).otherwise(F.replace(number, F.lit(","), F.lit(".")))
    own = F.regexp_extract(s, r"^-?[\d.,]+\s*(mm|cm|m|in|\")\.?$", 1)
    own = F.when(own == '"', "in").when(own != "", own)
    used = F.coalesce(own, unit if unit is not None else F.lit(None).cast("string"), F.lit("m"))
    factor = reduce(lambda c, kv: c.when(used == kv[0], kv[1]), list(METRES.items())[1:], F.when(used == "m", 1.0))
    whole = F.when(own.isNotNull() | s.rlike(r"^-?[\d.,]+$"), number.try_cast("double") * factor)
    imperial = clean_number(feet) * METRES["ft"] + F.coalesce(clean_number(F.when(inches != "", inches)), F.lit(0.0)) * METRES["in"]
    return F.when(feet != "", imperial).otherwise(whole)


def flag_is(flag: Column, name: str) -> Column:
    """Quality flags are ``name`` or ``name:detail``."""
    return (flag == name) | flag.startswith(name + ":")


def evidence(score: Column) -> Column:
    """-ln(1 - score), with the score kept under 1."""
    return -F.log1p(-F.least(score, F.lit(1 - 1e-12)))


def canonical_json(names: list[str]) -> Column:
    """Columns as JSON with sorted keys, for content keys."""
    return F.to_json(F.struct(*sorted(names)))


def short_id(name: Column, room: Column) -> Column:
    """A child's id without its room's id and the dash before it."""
    lead = F.concat(room, F.lit("-"))
    return F.when(name.startswith(lead), F.substring(name, F.length(lead) + 1, F.length(name))).otherwise(name)


def exif_to_iso(text: Column, offset: Column) -> Column:
    """A camera's local time "YYYY:MM:DD HH:MM:SS" as ISO 8601, with the offset if it is one; other text as it is."""
    form = r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2}).*$"
    plain = F.regexp_replace(text, form, "$1-$2-$3T$4:$5:$6")
    zone = F.when(offset.rlike(r"^[+-]\d{2}:\d{2}$"), offset).otherwise("")
    return F.when(text.rlike(form), F.concat(plain, F.coalesce(zone, F.lit("")))).otherwise(text)


def centimetres(metres: Column) -> Column:
    return F.format_string("%.1f cm", metres * 100)


def percent(share: Column) -> Column:
    """A share in percent; n/a for none or one that is not finite."""
    return F.when(share.isNull() | F.isnan(share) | (F.abs(share) == float("inf")), "n/a").otherwise(F.format_string("%.1f%%", share * 100))


def interval_text(value: Column, lo: Column, hi: Column, digits: int = 3) -> Column:
    """value [lo, hi], or a dash without a value."""
    f = f"%.{digits}f"
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"{f} [{f}, {f}]", value, lo, hi))


def confidence_weight(confidence: Column, reference: float) -> Column:
    """ln(confidence) over ln(reference), held in [0, 1]; missing confidence counts as 1, so as no weight."""
    c = F.greatest(F.coalesce(F.nanvl(confidence, F.lit(1.0)), F.lit(1.0)), F.lit(1.0))
    return F.least(F.greatest(F.log(c) / math.log(reference), F.lit(0.0)), F.lit(1.0))

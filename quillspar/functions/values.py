"""Parameter names, values and units as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS, TRIM, strip

# Fields and their labels; the first field with a label in the name wins, so the order counts.
FIELDS = {
    "manufacturer": ("制造商", "厂商", "品牌", "Manufacturer", "Brand"),
    "model": ("型号", "产品型号", "Model", "Part Number", "P/N"),
    "sensor_type": ("类型", "传感器类型", "Sensor Type", "Type"),
    "range": ("量程", "测量范围", "测距范围", "Range", "Measurement Range"),
    "accuracy": ("精度", "准确度", "Accuracy"),
    "resolution": ("分辨率", "Resolution"),
    "sampling_rate": ("采样率", "刷新率", "Sampling Rate", "Rate"),
    "response_time": ("响应时间", "Response Time"),
    "operating_temperature": ("工作温度", "Operating Temperature"),
    "power": ("电源", "供电", "Power", "Supply Voltage"),
    "interface": ("接口", "通信接口", "Interface", "Communication"),
    "dimensions": ("尺寸", "外形尺寸", "Dimensions", "Size"),
    "weight": ("重量", "Weight"),
    "ip_rating": ("防护等级", "IP 等级", "IP Rating", "Ingress Protection"),
    "fov": ("视场角", "FOV", "Field of View"),
    "wavelength": ("波长", "Wavelength"),
}
VALUE = r"(?U)^([<>≤≥~±+\-]?\s*[\d.]+(?:\s*[-~]\s*[\d.]+)?)(\s*[^\d\s]+.*)?$"
COLONS = ":："
TABLE_CONFIDENCE, PAIR_CONFIDENCE, CONFIRMED = 0.85, 0.80, 0.05


def folded(name: Column) -> Column:
    """A name as labels are looked for in it: lower case, white space made single."""
    return F.lower(F.regexp_replace(strip(name), r"(?U)\s+", " "))


def field_in(low: Column) -> Column:
    """The field whose label a folded name contains, null if none. ``low`` should be a column, as it is looked into for every label."""
    out = None
    for field, labels in FIELDS.items():
        hit = reduce(lambda a, b: a | b, [low.contains(x) for x in sorted({x.lower() for x in labels})])
        out = F.when(hit, field) if out is None else out.when(hit, field)
    return out


def field_of(name: Column) -> Column:
    """The field whose label the name contains, null if none."""
    return field_in(folded(name))


def value_of(text: Column) -> Column:
    """The number (or range) that a value begins with; the whole value if it isn't a number with a unit."""
    clean = strip(text)
    number = F.regexp_extract(clean, VALUE, 1)  # never empty where the pattern matches
    return F.when(number != "", strip(number)).otherwise(clean)


def unit_of(text: Column) -> Column:
    """The unit after the number, null if none."""
    return F.nullif(strip(F.regexp_extract(strip(text), VALUE, 2)), F.lit(""))


def colon(line: Column) -> Column:
    """Where the first colon of a line is, from 1; null if there is none."""
    return F.least(*[F.nullif(F.instr(line, c), F.lit(0)) for c in COLONS])


def pair(line: Column, head: Column, rest: Column) -> Column:
    """(name, found): the label and the value of a 'label: value' line, null for other lines.

    ``head`` and ``rest`` are what lies before and after the first colon; they should be columns. The line has no line end and no white space at its ends. A line has 4 to 300
    characters, a label 2 to 60 (white space before the colon doesn't count beyond), a value up to 180.
    """
    bare = F.ltrim(rest)
    value = F.when((bare > " ") & (bare < "\x7f"), bare).otherwise(F.ltrim(rest, F.lit(BLANKS)))
    long = (F.length(head) > 60) & (F.length(F.rtrim(head, F.lit(BLANKS))) > 60)
    fits = F.length(line).between(4, 300) & (F.length(head) >= 2) & ~long & F.length(value).between(1, 180)
    return F.when(fits, F.struct(strip(head).alias("name"), F.btrim(value, F.lit(TRIM)).alias("found")))

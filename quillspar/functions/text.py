"""Tokens, chunk windows and text evidence as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns of tokens and labels.
CJK = r"[\x{4e00}-\x{9fff}]"
CHUNK_TOKEN = r"(?U)[\x{4e00}-\x{9fff}]|[A-Za-z0-9_./%+\-]+|[^\s]"
SEARCH_TOKEN = r"[\x{4e00}-\x{9fff}]|[a-z0-9_./%+\-]+"
MANUFACTURER = r"(?iU)(?:制造商|厂商|品牌|Manufacturer|Brand)\s*[:：]\s*([A-Za-z0-9\x{4e00}-\x{9fff} ._\-&()]+)"
MODEL_LABEL = r"(?iU)(?:型号|产品型号|Model|Part\s*Number|P/N)\s*[:：]\s*([A-Za-z0-9_\-./]+)"
MODEL_DESIGNATOR = r"\b([A-Z]{1,6}[-_]?\d{2,6}[A-Z0-9\-_.]*)\b"
NOT_MODELS = r"^v\d|^\d+[.]\d+|^[a-z]{1,3}\d{1,2}$"
NOT_MODEL_PREFIXES = (
    "iso", "iec", "ieee", "ansi", "din", "jis", "gb", "gbt", "en", "ul", "ce", "fcc", "rohs", "reach", "mil", "nema", "rs", "ip", "usb", "hdmi", "vga",
    "tcp", "udp", "i2c", "spi", "can", "uart", "pwm", "adc", "dac", "led", "lcd", "pcb", "utf", "ascii", "gbk", "big", "euc", "v", "ver", "rev", "rel",
    "dc", "ac", "db", "hz", "khz", "mhz", "ghz", "kb", "mb", "tb", "kib", "mib", "gib", "bit", "byte", "api", "sdk", "ide", "cli", "gui", "ui", "url", "uri",
    "pdf", "doc", "xls", "ppt", "csv", "xml", "json", "html", "cpu", "gpu", "ram", "rom", "ssd", "hdd", "lan", "wan", "wifi", "bt", "ble", "nfc", "rfid",
    "id", "sn", "pn", "no", "nr",
)
TRIM = " ;,，。"
#: All white space of Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A space that doesn't stay between two tokens.
GLUED = r" (?:(?=[\x{4e00}-\x{9fff},.!?;:%)\]}])|(?<=[\x{4e00}-\x{9fff}(\[{/\-] ))"


def strip(x: Column) -> Column:
    """The text without Unicode white space at its ends. As to look for every blank is slow, it is not done where visible ASCII characters are left at both ends without plain spaces."""
    seen = lambda c: (c > " ") & (c < "\x7f")  # noqa: E731  by the first character
    bare = F.trim(x)
    return F.when(seen(bare) & seen(F.substring(bare, -1, 1)), bare).otherwise(F.btrim(x, F.lit(BLANKS)))


def lines(x: Column) -> Column:
    """The lines of a text, which any line end of Unicode parts. Splitting by a pattern makes the pattern anew for each row, so it is kept for texts that need it."""
    odd = reduce(lambda a, b: a | b, [x.contains(c) for c in "\r\x0b\x0c\x85\u2028\u2029"])
    return F.when(odd, F.split(x, r"\R")).otherwise(F.split(x, "\n"))


def chunk_tokens(text: Column) -> Column:
    """Approximate tokens: a CJK character, a run of word characters, or one other character."""
    return F.regexp_extract_all(text, F.lit(CHUNK_TOKEN), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Lower-case search terms."""
    return F.regexp_extract_all(F.lower(text), F.lit(SEARCH_TOKEN), F.lit(0))


def untokenize(tokens: Column) -> Column:
    """Readable text of tokens, which have no white space: no space beside CJK, before closing marks or after opening ones."""
    return F.regexp_replace(F.array_join(tokens, " "), GLUED, "")


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """0-based token offsets of windows of ``size`` over n tokens; none for no tokens, one if all fit."""
    step = max(1, size - overlap)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def labelled(text: Column, pattern: str) -> Column:
    """The first group of the first match, without marks at its ends; null if there is no match."""
    return F.when(text.rlike(pattern), F.btrim(F.regexp_extract(text, pattern, 1), F.lit(TRIM)))


def manufacturer(text: Column) -> Column:
    """The maker named after a label, or null."""
    return labelled(text, MANUFACTURER)


def sensor_model(text: Column) -> Column:
    """A labelled model, else the first designator that isn't a standard, an interface or a version; null if none."""

    def fits(x: Column) -> Column:
        low = F.lower(x)
        return ~F.regexp_extract(low, r"^[a-z]+", 0).isin(*NOT_MODEL_PREFIXES) & ~low.rlike(NOT_MODELS) & (F.length(x) >= 4)

    found = F.transform(F.regexp_extract_all(text, F.lit(MODEL_DESIGNATOR), F.lit(1)), lambda x: F.btrim(x, F.lit(TRIM)))
    label = labelled(text, MODEL_LABEL)
    return F.when(label != "", label).otherwise(F.get(F.filter(found, fits), F.lit(0)))


def table_to_markdown(rows: Column) -> Column:
    """ARRAY<ARRAY<STRING>> as a Markdown table: null cells are empty, blank rows go, short rows are filled up."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    kept = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(kept, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    full = F.transform(kept, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    ruled = F.concat(F.slice(full, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))))
    return F.when(F.size(kept) > 0, F.array_join(ruled, "\n")).otherwise(F.lit(""))


def highlight(text: Column, query: str) -> Column:
    """Query words of two characters or more, wrapped wherever they occur in any case; earlier words win where several match."""
    words = [w for w in re.findall(r"[\u4e00-\u9fff]+|[a-z0-9_./%+-]+", query.lower()) if len(w) >= 2]
    if not words:
        return text
    return F.regexp_replace(text, "(?iu)(" + "|".join(re.escape(w) for w in words) + ")", '<span class="highlight">$1</span>')


def preview(text: Column, limit: int = 800) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def percent(score: Column) -> Column:
    """A score as a whole percentage from 0 to 100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(score * 100).cast("int")))

"""File types, exclusion rules and path predicates as column expressions."""

from __future__ import annotations

from functools import reduce
from mimetypes import MimeTypes

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes, names, headers and limits of the rules.
PDF, WORD = [".pdf"], [".docx"]
TEXT = [".txt", ".md", ".json", ".yaml", ".yml"]
CODE = [".py", ".c", ".cc", ".cpp", ".h", ".hpp", ".java", ".js", ".ts", ".cs", ".go", ".rs", ".m", ".matlab"]
CAPTURE = [".cap", ".pcap", ".pcapng"]
AUDIO = [".aac", ".ac3", ".aif", ".aiff", ".alac", ".amr", ".ape", ".au", ".flac", ".m4a", ".m4b", ".mid", ".midi", ".mka", ".mp3", ".oga", ".ogg", ".opus", ".ra", ".wav", ".weba", ".wma"]
VIDEO = [".3g2", ".3gp", ".asf", ".avi", ".divx", ".dv", ".f4v", ".flv", ".m2ts", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".mts", ".mxf", ".ogv", ".rm", ".rmvb", ".vob", ".webm", ".wmv"]
#: Suffixes whose registered type is audio or video.
MEDIA_TYPES = sorted(s for s, kind in MimeTypes().types_map[True].items() if kind.startswith(("audio/", "video/")) and s != ".ts")
DATABASE = [".bak", ".db", ".ddl", ".dml", ".dump", ".sql", ".sqlite", ".sqlite3", ".sqlite-shm", ".sqlite-wal"]
DATABASE_FOLDERS = r"(^|/)(\.chroma|data/chroma)(/|$)"
CSV = [".csv"]
MAX_TXT_BYTES = 1024 * 1024
CAPTURE_HEADERS = ["A1B2C3D4", "D4C3B2A1", "A1B23C4D", "4D3CB2A1", "0A0D0D0A"]
MEDIA_HEADERS = ["494433", "664C6143", "4F676753", "464C56", "1A45DFA3", "000001BA", "000001B3", "3026B2758E66CF11A6D900AA0062CE6C"]
REASONS = {
    "capture": "PCAP files are excluded from RAG import",
    "media": "audio and video files are excluded from RAG import",
    "database": "database-related files are excluded from RAG import",
    "csv": "CSV files are excluded from RAG import",
    "type": "unsupported file type",
    "size": f"TXT files larger than {MAX_TXT_BYTES} bytes are excluded",
}
HEADER_BYTES = 377


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The lower-case suffix with its dot; '' if the name has none or begins with its only dot."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1))


def file_type(path: Column) -> Column:
    """pdf, docx, text, code or unsupported, by suffix."""
    s = suffix(path)
    return F.when(s.isin(*PDF), "pdf").when(s.isin(*WORD), "docx").when(s.isin(*TEXT), "text").when(s.isin(*CODE), "code").otherwise("unsupported")


def _byte(header: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(header, at + 1, 1)), 16, 10).cast("int")


def is_transport_stream(header: Column) -> Column:
    """MPEG-TS sync bytes at 0, 188 and 376."""
    return (F.octet_length(header) >= HEADER_BYTES) & reduce(lambda a, b: a & b, [_byte(header, k) == 0x47 for k in (0, 188, 376)])


def is_audio_frame(header: Column) -> Column:
    """An MPEG audio frame's sync bits."""
    return (F.octet_length(header) >= 2) & (_byte(header, 0) == 0xFF) & (_byte(header, 1).bitwiseAND(F.lit(0xE0)) == 0xE0)


def is_capture(path: Column, header: Column) -> Column:
    return suffix(path).isin(*CAPTURE) | F.coalesce(F.hex(F.substring(header, 1, 4)).isin(*CAPTURE_HEADERS), F.lit(False))


def is_media(path: Column, header: Column) -> Column:
    h = F.hex(F.substring(header, 1, 16))
    known = reduce(lambda a, b: a | b, [h.startswith(x) for x in MEDIA_HEADERS])
    riff = h.startswith("52494646") & F.substring(h, 17, 8).isin("57415645", "41564920")
    magic = known | riff | (F.substring(h, 9, 8) == "66747970") | is_audio_frame(header) | is_transport_stream(header)
    return suffix(path).isin(*AUDIO, *VIDEO, *MEDIA_TYPES) | F.coalesce(magic, F.lit(False))


def is_database(path: Column) -> Column:
    return suffix(path).isin(*DATABASE) | F.lower(path).rlike(DATABASE_FOLDERS)


def exclusion_reason(path: Column, size: Column, header: Column) -> Column:
    """Why a file isn't imported, by the first rule that holds; null for a file that is. ``header``: its first 377 bytes, or null."""
    return (
        F.when(is_capture(path, header), REASONS["capture"])
        .when(is_media(path, header), REASONS["media"])
        .when(is_database(path), REASONS["database"])
        .when(suffix(path).isin(*CSV), REASONS["csv"])
        .when(file_type(path) == "unsupported", REASONS["type"])
        .when((suffix(path) == ".txt") & (size > MAX_TXT_BYTES), REASONS["size"])
    )


def under_root(path: Column, root: str) -> Column:
    """Whether the path is the root or lies below it, by whole components."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(f"{root}/")

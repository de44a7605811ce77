"""Benchmark passages in documents, found as templates. DataFrame functions only: nothing here runs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, only, small

#: Tokens of a window, and how many of them must be plain words.
WINDOW, LITERALS = 8, 5
#: Items left without such a window are searched word for word: whole from LEAST tokens up, by windows of MOST if longer.
LEAST, MOST = 5, 16
UNITS = tuple("mm cm dm m km g kg mg t s ms min h hz khz mhz ghz v mv kv a ma w kw mw kwh j kj n pa kpa mpa bar psi k c f l ml ft in mi mph kmh lb oz usd eur gbp percent degrees seconds minutes hours days weeks months years meters metres kilometers kilometres grams kilograms miles feet inches dollars euros pounds liters litres".split())
_TOKEN = r"\p{Nd}+(?:[.,]\p{Nd}+)*|\p{L}+|[.!?\n]"


def _is_number(x: Column) -> Column:
    return x.rlike(r"^\p{Nd}")


def _is_mark(x: Column) -> Column:
    return x.isin(".", "!", "?", "\n")


def raw_tokens(text: Column) -> Column:
    """Numbers, words and sentence marks of a text."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _canonical(x: Column, before: Column) -> Column:
    """The typed placeholder or the lower-case word that a token becomes; null for a sentence mark.

    A number is <num>, a unit word right after a number <unit>, a capitalised word inside a sentence <name>. Words all in capitals are plain.
    """
    rest = F.substr(x, F.lit(2))
    name = (F.length(x) > 1) & (rest == F.lower(rest)) & before.isNotNull() & ~_is_mark(before)
    low = F.lower(x)
    word = F.when(low.isin(*UNITS), F.when(_is_number(F.coalesce(before, F.lit(""))), F.lit("<unit>")).otherwise(low))
    other = word.when(x.rlike(r"^\p{Ll}"), low).when(_is_mark(x), F.lit(None).cast("string")).when(_is_number(x), F.lit("<num>")).when(name & (F.substring(x, 1, 1) != F.substring(low, 1, 1)), F.lit("<name>")).otherwise(low)
    plain = F.when(low.isin(*UNITS) & _is_number(F.coalesce(before, F.lit(""))), F.lit("<unit>")).otherwise(low)
    return F.when(F.substring(x, 1, 1).between("a", "z"), plain).otherwise(other)  # most tokens, told without a pattern


def canonical_tokens(raw: Column) -> Column:
    """Canonical forms of the tokens in ``raw``, which must be a column: the expression is looked into for every token."""
    return F.array_compact(F.transform(raw, lambda x, i: _canonical(x, F.get(raw, i - 1))))


def plain_tokens(raw: Column) -> Column:
    """The tokens in lower case at the places of their canonical forms."""
    return F.transform(F.filter(raw, lambda x: ~_is_mark(x)), lambda x: F.lower(x))


def _with_hashes(df: DataFrame, lengths: list[int], tokens: str = "canon") -> DataFrame:
    """``df`` with ``hashes_n`` for each of the lengths: hashes of its windows of n tokens, one for each place.

    Hashes of 1, 2, 4, ... tokens come from those of half as many, so a token costs a few operations whatever the window. Each is a projection
    of its own, as an expression that is used twice within another would be computed twice.
    """
    kept, most = df.columns, max(lengths, default=0)
    df = df.withColumn("power_1", F.transform(tokens, lambda x: F.xxhash64(x)))

    def joined(a: str, b: str, shift: int) -> Column:
        n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(b, 1 + shift, n), lambda x, y: F.xxhash64(x, y))

    size = 1
    while 2 * size <= most:
        df = df.withColumn(f"power_{2 * size}", joined(f"power_{size}", f"power_{size}", size))
        size *= 2
    for n in lengths:
        powers = [1 << k for k in range(n.bit_length()) if n >> k & 1][::-1]
        df, done = df.withColumn("part_1", F.col(f"power_{powers[0]}")), powers[0]
        for p in powers[1:]:
            df, done = df.withColumn("part_1", joined("part_1", f"power_{p}", done)), done + p
        df = df.withColumn(f"hashes_{n}", F.col("part_1"))
    return df.select(*kept, *[f"hashes_{n}" for n in lengths])


def _exploded(df: DataFrame, lengths: list[int], wanted=lambda n: F.lit(True)) -> DataFrame:
    """``df`` with a row (pos, len, hash) for each window of the lengths that are ``wanted``."""
    kept = [c for c in df.columns if c not in {f"hashes_{n}" for n in lengths}]
    if not lengths:
        return df.select(*kept, F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("hash")).limit(0)
    each = F.array(*[F.struct(F.lit(n).alias("len"), F.when(wanted(n), F.col(f"hashes_{n}")).alias("hashes")) for n in lengths])
    df = df.select(*kept, F.explode(each).alias("w")) if len(lengths) > 1 else df.select(*kept, F.get(each, F.lit(0)).alias("w"))
    return df.select(*kept, F.col("w.len").alias("len"), F.posexplode("w.hashes").alias("pos", "hash")).select(*kept, "pos", "len", "hash")


def _is_slot(x: Column) -> Column:
    return x.isin("<num>", "<unit>", "<name>")


def _slots(canon: Column, plain: Column, pos: Column, length: Column) -> Column:
    """The lower-case tokens under a window's placeholders."""
    both = F.arrays_zip(F.slice(canon, pos + 1, length).alias("c"), F.slice(plain, pos + 1, length).alias("p"))
    return F.transform(F.filter(both, lambda x: _is_slot(x["c"])), lambda x: x["p"])


def templates(benchmark: DataFrame, item_col: str, text_col: str, window: int, literals: int) -> DataFrame:
    """The searched windows of the items: (item, pos, len, hash, want, slots). An item shorter than a window is one window.

    Windows of fewer plain words than ``literals`` are left out, as is an item that has no other.
    """
    items = only(benchmark, item=item_col, text=text_col).where("text is not null").withColumn("raw", raw_tokens(F.col("text")))
    items = items.select("item", canonical_tokens(F.col("raw")).alias("canon"), plain_tokens(F.col("raw")).alias("plain"))
    lengths = list(range(1, window + 1))
    items = _exploded(_with_hashes(items, lengths), lengths, lambda n: F.size("canon") >= n if n == window else F.size("canon") == n)
    items = items.select("item", "pos", "len", "hash", F.slice("canon", F.col("pos") + 1, F.col("len")).alias("want"), _slots(F.col("canon"), F.col("plain"), F.col("pos"), F.col("len")).alias("slots"))
    return items.where(F.size(F.filter("want", lambda x: ~_is_slot(x))) >= literals)


def _has_window(canon: Column, window: int, literals: int) -> Column:
    """Whether templates keeps a window of these tokens."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(canon) - window + 1, F.lit(1)))
    return F.exists(starts, lambda i: F.size(F.filter(F.slice(canon, i, window), lambda x: ~_is_slot(x))) >= literals)


def _without_window(benchmark: DataFrame, item_col: str, text_col: str, window: int, literals: int) -> DataFrame:
    items = only(benchmark, item=item_col, text=text_col).where("item is not null and text is not null").withColumn("raw", raw_tokens(F.col("text")))
    items = items.select("item", canonical_tokens(F.col("raw")).alias("canon"), plain_tokens(F.col("raw")).alias("plain"))
    return items.where(~_has_window(F.col("canon"), window, literals)).select("item", "plain")


def unsearchable(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", exact: bool = False, window: int = WINDOW, literals: int = LITERALS) -> int:
    """How many items can't be found: those without a window of enough plain words, or with ``exact`` those of them with fewer than LEAST tokens."""
    return _without_window(benchmark, item_col, text_col, window, literals).where(F.size("plain") < LEAST if exact else F.lit(True)).count()


def _exact_pairs(keyed: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, window: int, literals: int) -> DataFrame | None:
    """(id, h, item) where a row has an item without window, or MOST tokens of it, token for token in lower case; None if there are no such items."""
    items = _without_window(benchmark, item_col, item_text, window, literals).where(F.size("plain") >= LEAST)
    lengths = sorted(r.n for r in items.select(F.least(F.size("plain"), F.lit(MOST)).alias("n")).distinct().collect())  # at most MOST values
    if not lengths:
        return None
    wanted = _exploded(_with_hashes(items, lengths, "plain"), lengths, lambda n: F.size("plain") >= n if n == MOST else F.size("plain") == n)
    wanted = wanted.select("item", "len", "hash", F.slice("plain", F.col("pos") + 1, F.col("len")).alias("want")).distinct()
    index = wanted.select("len", "hash").distinct()
    rows = _canonical_rows(keyed).select("id", "h", "plain")
    found = _exploded(_with_hashes(rows, lengths, "plain").drop("plain"), lengths)
    hits = cut(found.join(small(index), ["len", "hash"]).distinct())
    sources = _hit_rows(keyed, hits)
    sources = _canonical_rows(sources).select(F.col("id").alias("i"), F.col("h").alias("g"), "plain")
    seen = hits.join(sources, same_row(F.col("id"), F.col("h"))).select("id", "h", "len", "hash", F.slice("plain", F.col("pos") + 1, F.col("len")).alias("have"))
    return seen.join(wanted, ["len", "hash"]).where(F.col("have") == F.col("want")).select("id", "h", "item")


def _canonical_rows(keyed: DataFrame) -> DataFrame:
    return keyed.where("text is not null").select("id", "h", raw_tokens(F.col("text")).alias("raw")).select("id", "h", canonical_tokens(F.col("raw")).alias("canon"), plain_tokens(F.col("raw")).alias("plain"))


def _hit_rows(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows that hits (id, h) name, once each."""
    named = hits.select(F.col("id").alias("i"), F.col("h").alias("g")).distinct()
    return keyed.join(small(named), same_row(F.col("id"), F.col("h")), "left_semi").dropDuplicates(["id", "h"])


def same_row(id_col: Column, h: Column) -> Column:
    """Whether a flagged row (i, g) is the row of this id, which may be null, and this hash of the text."""
    return id_col.eqNullSafe(F.col("i")) & (h == F.col("g"))


def flagged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, literals: int = LITERALS, exact: bool = False) -> DataFrame:
    """The contaminated rows alone: (i, g, n_windows, items), i being the id and g xxhash64 of the text. See contaminated."""
    wanted = templates(benchmark.where(F.col(f"`{item_col}`").isNotNull()), item_col, item_text, window, literals)
    keyed = only(docs, id=id_col, text=text_col).withColumn("h", F.xxhash64("text"))
    index = wanted.select("len", "hash").distinct()
    lengths = sorted(r.len for r in index.select("len").distinct().collect())  # at most ``window`` values
    found = _exploded(_with_hashes(_canonical_rows(keyed).select("id", "h", "canon"), lengths).drop("canon"), lengths)
    hits = cut(found.join(small(index), ["len", "hash"]).distinct())  # few rows, which are read twice
    sources = _hit_rows(keyed, hits)
    sources = _canonical_rows(sources).select(F.col("id").alias("i"), F.col("h").alias("g"), "canon", "plain")
    seen = hits.join(sources, same_row(F.col("id"), F.col("h")))
    seen = seen.select("id", "h", "pos", "len", "hash", F.slice("canon", F.col("pos") + 1, F.col("len")).alias("have"), _slots(F.col("canon"), F.col("plain"), F.col("pos"), F.col("len")).alias("values"))
    # Which slots hold the same value is all that counts of an item's values, so items that share a window and that are one row.
    pattern = F.transform("slots", lambda x: F.array_position(F.col("slots"), x))
    shared = wanted.groupBy("len", "hash", "want", pattern.alias("pattern")).agg(F.count("*").alias("times"), F.collect_set("item").alias("items"))
    pairs = seen.join(shared, ["len", "hash"]).where(F.col("have") == F.col("want"))
    pairs = pairs.where(F.size(F.array_distinct(F.arrays_zip("pattern", "values"))) == F.size(F.array_distinct("pattern")))
    pairs = pairs.select("id", "h", "times", "items")
    more = _exact_pairs(keyed, benchmark, item_col, item_text, window, literals) if exact else None
    pairs = pairs if more is None else pairs.unionByName(more.select("id", "h", F.lit(1).cast("bigint").alias("times"), F.array("item").alias("items")))
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return pairs.groupBy("id", "h").agg(F.sum("times").alias("n_windows"), every.alias("items")).select(F.col("id").alias("i"), F.col("h").alias("g"), "n_windows", "items")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, literals: int = LITERALS, exact: bool = False) -> DataFrame:
    """Per row of ``docs``: (id, contaminated, n_windows, items).

    A row is contaminated if one of its windows has the template of a window of an item, and each value under the item's placeholders
    corresponds to one value in the row's: '3 of 3 km' matches '5 of 5 miles' and not '5 of 6 miles'. ``n_windows`` counts such window
    pairs, ``items`` lists the items in order. Case and punctuation don't matter. Null texts, texts shorter than a window and
    rows against an empty benchmark are clean; repeated rows are judged alike; a null id keeps its row; items of null text or null id
    are left out; only the named columns are read.

    Windows of fewer than ``literals`` plain words are not searched. An item that has no other is found only with ``exact``, and then token for token in lower
    case, numbers and names too: whole, or any MOST tokens of it if it is longer; one of fewer than LEAST tokens is never found (see unsearchable).

    Windows are matched by hash first and by their tokens for the few rows that hit, whose texts alone are moved. Templates are made distinct before the joins, so a
    window that many items share meets each row once.
    """
    flags = flagged(docs, benchmark, id_col, text_col, item_col, item_text, window, literals, exact)
    keyed = only(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("h"))
    out = keyed.join(flags, same_row(F.col("id"), F.col("h")), "left")
    return out.select("id", F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("items", F.array().cast(dict(flags.dtypes)["items"])).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) that are not contaminated, all columns kept. Items without a window are searched too."""
    gone = small(cut(flagged(docs, benchmark, exact=True).select("i", "g")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["i"]) & (F.xxhash64(docs["text"]) == gone["g"]), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contaminated(docs, benchmark)
    return out.select(F.col("id").alias("doc_id"), "contaminated", "n_windows", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def _sql_tokens(table: str, key: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    mark = "x IN ('.', '!', '?', chr(10))"
    return f"""
    SELECT {key} AS id, list_filter(list_transform(raw, lambda x, i: CASE
               WHEN {mark} THEN NULL
               WHEN regexp_matches(x, '^\\p{{Nd}}') THEN '<num>'
               WHEN lower(x) IN ({units}) AND i > 1 AND regexp_matches(raw[i - 1], '^\\p{{Nd}}') THEN '<unit>'
               WHEN length(x) > 1 AND substr(x, 2) = lower(substr(x, 2)) AND substr(x, 1, 1) <> lower(substr(x, 1, 1)) AND i > 1 AND NOT raw[i - 1] IN ('.', '!', '?', chr(10)) THEN '<name>'
               ELSE lower(x) END), lambda x: x IS NOT NULL) AS canon,
           list_transform(list_filter(raw, lambda x: NOT {mark}), lambda x: lower(x)) AS plain
    FROM (SELECT {key}, regexp_extract_all(text, '\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*|\\p{{L}}+|[.!?\\n]') AS raw FROM {table} WHERE text IS NOT NULL)"""


OP8_SQL = f"""
WITH d AS ({_sql_tokens("documents", "doc_id")}),
b AS ({_sql_tokens("benchmark", "item_id")}),
bw AS (SELECT id AS item, canon, plain, least({WINDOW}, len(canon)) AS k, unnest(range(0, len(canon) - least({WINDOW}, len(canon)) + 1)) AS p FROM b WHERE len(canon) > 0),
t AS (SELECT item, k, canon[p + 1 : p + k] AS want, plain[p + 1 : p + k] AS ps FROM bw),
u AS (SELECT item, k, want, list_transform(list_filter(list_zip(want, ps), lambda z: z[1] IN ('<num>', '<unit>', '<name>')), lambda z: z[2]) AS slots
      FROM t WHERE len(list_filter(want, lambda x: NOT x IN ('<num>', '<unit>', '<name>'))) >= {LITERALS}),
ks AS (SELECT DISTINCT k FROM u),
dw AS (SELECT id, canon, plain, k, unnest(range(0, len(canon) - k + 1)) AS p FROM d, ks WHERE len(canon) >= k),
v AS (SELECT id, k, canon[p + 1 : p + k] AS have, plain[p + 1 : p + k] AS ps FROM dw),
m AS (SELECT v.id, u.item FROM v JOIN u ON v.k = u.k AND v.have = u.want
      WHERE len(list_distinct(list_zip(u.slots, list_transform(list_filter(list_zip(v.have, v.ps), lambda z: z[1] IN ('<num>', '<unit>', '<name>')), lambda z: z[2])))) = len(list_distinct(u.slots))),
f AS (SELECT id, count(*) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY id)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_windows, coalesce(items, '') AS items FROM documents LEFT JOIN f ON doc_id = id
"""

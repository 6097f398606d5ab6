"""Line deduplication by an exact set-similarity join of lines.

A line is the set of its lower-cased words, ordered by rarity. The index holds steps: a word
and the one after it, the last word and the end. A word that only this line has takes at most
two of its steps from a pair, one that only the other line has at most one. A line of ``n``
words with a partner of Jaccard similarity ``t > 0.5`` has ``x`` words of its own and the
partner ``y`` with ``x + t * y <= (1 - t) * n``, so at most ``2 * (1 - t) * n`` steps are lost
and the least common step is among the first ``floor(2 * (1 - t) * n) + 1`` of both lines. For
lower ``t`` a word is a step, and ``n - ceil(t * n) + 1`` of them do. Two rare words that follow
each other are in far fewer lines than one, so the groups stay small as the corpus grows.
Candidate pairs share a step and have sizes within the factor ``t`` (length filter). A map of
128 bits, one of which each word turns over, bounds the common words from above as well: every
differing bit is a word that only one line has. Candidates are verified on the whole sets, and
a line that matches an earlier line, by document id and position, is removed.

Equal sets are grouped before anything is joined, so copies are never paired. Sets too small
to match any but an equal set (one to three words at 0.8) are not in the index. The lines of
a step are paired in the pass that groups them when there are at most ``GROUP`` of them, each with the
lines before it, so only pairs that pass the filters are written. Each line is held
against its nearest partner by the maps first. Steps of
a family of near copies form large groups all the same; there the partners of a line are first
the group's earliest line and the ``BEFORE`` lines before it, and only lines that the nearest
of them does not settle are paired with all the earlier lines of their groups. Whether a line
goes does not depend on which of its
matches is found, so this leaves the result of the exact join. The steps are grouped in
``SLICES`` parts by their hash, one after the other, and only steps that several lines have are
kept, so that no shuffle holds all of them.

All of it is DataFrame expressions. The lines are cut into words once and written as hashes.
Rarity is the number of lines with a word of the hash class, counted for each word; there are
65,536 classes at any input size, and any fixed order of the words keeps the join exact. The index tells words apart by 56 bits of their hash, steps by 40 and sets of words
by 64; candidates are verified on the words themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import collect_garbage, discard, settle, settle_bucketed

SIMILARITY_PERCENT = 80
MIN_WORDS = 5
CLASSES = 1 << 16
SLICES = 4
GROUP, BEFORE = 32, 8


def _words(text: str) -> str:
    """The words of a text column, in their order; none are empty."""
    return f"array_remove(split(lower({text}), '[ \\t\\r\\u000c\\u000b]'), '')"


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as ``doc_id, key, text``: the key tells texts of one id apart, and equals of both are one row
    to everything that follows."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _hashed(rows: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, key, pos, hashes``: the different words of the lines of at least ``min_words`` words, and one, as hashes.

    The words pass through ``explode``, so that the filter does not make Spark split the lines again.
    """
    place = ("doc_id", "key", "pos")
    lines = rows.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = lines.selectExpr(*place, f"explode(array({_words('line')})) AS found")
    return found.filter(F.size("found") >= max(min_words, 1)).selectExpr(
        *place, "array_distinct(transform(found, w -> xxhash64(w))) AS hashes"
    )


def _ranks(hashed: DataFrame) -> list[int]:
    """For each hash class, four times the binary logarithm of its occurrences, one for each line that has the word."""
    words = hashed.select(F.explode("hashes").alias("word"))
    counts = words.groupBy(F.col("word").bitwiseAND(CLASSES - 1).alias("class")).count()
    ranks = [0] * CLASSES
    for number, rank in counts.select("class", F.least(F.lit(127), F.floor(4 * F.log2(F.col("count") + 1)))).collect():
        ranks[number] = rank
    return ranks


def line_sets(hashed: DataFrame, ranks: list[int]) -> DataFrame:
    """``doc_id, key, pos, words``: the lines as sets of 56-bit hashes below seven bits of rarity, rarest first."""
    table = f"cast(split('{','.join(map(str, ranks))}', ',') as array<tinyint>)"
    rank = f"coalesce(get({table}, cast(h & {CLASSES - 1} as int)), 0Y)"
    return hashed.selectExpr(
        "doc_id", "key", "pos",
        f"sort_array(transform(hashes, h -> shiftleft(cast({rank} as bigint), 56) | shiftrightunsigned(h, 8))) AS words",
    )


def _steps(t: int) -> str:
    """The steps that a line of ``words`` needs in the index at ``t`` percent; none if only an equal set can match."""
    if t > 50:
        some = f"slice(words, 1, least(size(words), size(words) * {2 * (100 - t)} div 100 + 1))"
        some = f"transform({some}, (w, i) -> shiftrightunsigned(xxhash64(w, get(words, i + 1)), 24))"
    else:
        some = f"slice(words, 1, size(words) - (size(words) * {t} + 99) div 100 + 1)"
    return f"if(size(words) * 100 >= (size(words) + 1) * {t}, {some}, slice(words, 1, 0))"


def _map_of(half: int) -> str:
    """64 bits of a line's map of 128: a word turns over the bit of its hash's last seven bits."""
    return (
        f"aggregate(words, 0L, (m, w) -> m ^ if(w & 64 = {64 * half}, shiftleft(1L, cast(w & 63 as int)), 0L))"
    )


def _fits(t: int) -> str:
    """Length filter of a pair, and the bound by the maps."""
    need = f"((a_n + b_n) * {t} + {99 + t}) div {100 + t}"
    return (
        f"a_n * 100 >= b_n * {t} AND b_n * 100 >= a_n * {t} "
        f"AND a_n + b_n - bit_count(a_low ^ b_low) - bit_count(a_high ^ b_high) >= 2 * ({need})"
    )


_FILTERED = ("n", "low", "high")
_APART = "(bit_count(a_low ^ b_low) + bit_count(a_high ^ b_high)) / (a_n + b_n)"


def _shared_steps(firsts: DataFrame, part: int, percent: int) -> DataFrame:
    """The steps of one slice that several lines have.

    ``large`` rows are those of steps that more than ``GROUP`` lines have. The lines of all other steps are paired
    while they lie together: a row is the later ``line`` of a pair that passes the filters, the earlier one is ``other``.
    """
    spread = firsts.select("line", "doc_id", "pos", *_FILTERED, F.explode("steps").alias("step"))
    index = spread.filter(F.pmod("step", F.lit(SLICES)) == part)
    group = Window.partitionBy("step")
    index = index.withColumn("size", F.count("*").over(group)).filter("size > 1")
    index = index.withColumn("large", F.col("size") > GROUP).drop("size")
    here = F.when(~F.col("large"), F.struct("line", "doc_id", "pos", *_FILTERED))
    index = index.withColumn("others", F.collect_list(here).over(group.rowsBetween(1 - GROUP, -1)))
    index = index.withColumn("other", F.explode_outer("others")).withColumns(
        {f"{side}_{c}": F.col(f"{row}{c}") for side, row in (("a", ""), ("b", "other.")) for c in ("line", *_FILTERED)}
    )
    found = index.filter(f"large OR ({_fits(percent)})").withColumn(
        "later", F.struct("doc_id", "pos", "line") > F.struct("other.doc_id", "other.pos", "other.line")
    )
    found = found.selectExpr(
        "step", "large", "if(large OR later, a_line, b_line) AS line", "if(later, b_line, a_line) AS other",
        f"{_APART} AS apart", *(f"if(large, {c}, null) AS {c}" for c in ("doc_id", "pos", *_FILTERED)),
    )
    return settle_bucketed(found, "shared-steps", "step", compression="zstd")


def _all_partners(index: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """``a_line, b_line, apart``: ``lines`` of the index with all earlier lines of their steps' groups that pass the
    filters; ``apart`` is the share of their words that the maps tell apart."""
    columns = ("line", "doc_id", "pos", *_FILTERED)
    a = lines.select("step", *(F.col(c).alias(f"a_{c}") for c in columns))
    b = index.select(F.col("step").alias("b_step"), *(F.col(c).alias(f"b_{c}") for c in columns))
    earlier = F.struct("b_doc_id", "b_pos", "b_line") < F.struct(
        F.col("a_doc_id").alias("b_doc_id"), F.col("a_pos").alias("b_pos"), F.col("a_line").alias("b_line")
    )
    fits = (F.col("step") == F.col("b_step")) & earlier & F.expr(_fits(percent))
    return a.join(b, fits).selectExpr("a_line", "b_line", f"{_APART} AS apart")


def _some_partners(index: DataFrame, percent: int) -> DataFrame:
    """``a_line, b_line, apart``: each line with the first line of its steps' groups and the ``BEFORE`` lines
    before it there, among those that pass the filters."""
    group = Window.partitionBy("step").orderBy("doc_id", "pos", "line")
    here = F.struct("line", *_FILTERED)
    others = F.array(F.first(here).over(group), *(F.lag(here, k).over(group) for k in range(1, BEFORE + 1)))
    pairs = index.select("line", *_FILTERED, others.alias("others"))
    pairs = pairs.select(
        *(F.col(c).alias(f"a_{c}") for c in ("line", *_FILTERED)), F.explode("others").alias("other")
    ).filter("other.line <> a_line")
    pairs = pairs.selectExpr("a_line", *(f"a_{c}" for c in _FILTERED), *(f"other.{c} AS b_{c}" for c in ("line", *_FILTERED)))
    return pairs.filter(F.expr(_fits(percent))).selectExpr("a_line", "b_line", f"{_APART} AS apart")


def _texts(pairs: DataFrame, firsts: DataFrame, rows: DataFrame) -> DataFrame:
    """``line, body``: the words of the lines in ``pairs``, from the documents of their first places."""
    lines = pairs.select(F.explode(F.array("a_line", "b_line")).alias("line")).distinct()
    places = firsts.select("line", "doc_id", "key", "pos").join(lines, "line")
    places = places.groupBy("doc_id", "key").agg(F.collect_list(F.struct("pos", "line")).alias("wanted"))
    same = rows["doc_id"].eqNullSafe(places["doc_id"]) & (rows["key"] == places["key"])
    found = rows.join(places, same).select(F.explode("wanted").alias("place"), F.split("text", "\n").alias("lines"))
    return found.select("place.line", F.get("lines", F.col("place.pos")).alias("body"))


def _matched(pairs: DataFrame, firsts: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The lines ``line`` of the pairs whose whole sets of words are similar enough."""
    bodies = _texts(pairs, firsts, rows).dropDuplicates(["line"])
    sets = settle(bodies.selectExpr("line", f"array_distinct({_words('body')}) AS body"), "line-sets", compression="zstd")
    joined = pairs.join(sets.withColumnsRenamed({"line": "b_line", "body": "b"}), "b_line").join(
        sets.withColumnsRenamed({"line": "a_line", "body": "a"}), "a_line"
    )
    similar = joined.filter(f"size(array_intersect(a, b)) * {100 + percent} >= (size(a) + size(b)) * {percent}")
    found = settle(similar.select(F.col("a_line").alias("line")).distinct(), "matched")
    discard(sets)
    return found


def later_matches(
    docs: DataFrame,
    percent: int = SIMILARITY_PERCENT,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, key, pos`` of every line that is to be removed.

    A line goes if an earlier line, in the order of document id and position, has a Jaccard
    similarity of ``percent`` or more. Lines without a word, or below ``min_words`` words, take
    no part. Rows with
    equal id and text lose the same lines, those that the first of them loses; of different
    texts that share an id, lines at one position stand in the order of their hash. A null
    id comes before all others, a null text has one empty line.
    """
    rows = _numbered(docs, id_col, text_col)
    hashed = settle(_hashed(rows, min_words), "line-hashes", compression="zstd")
    sets = line_sets(hashed, _ranks(hashed))
    lines = settle(
        sets.selectExpr(
            "doc_id", "key", "pos", "xxhash64(words) AS line", "size(words) AS n", f"{_steps(percent)} AS steps",
            *(f"{_map_of(i)} AS {name}" for i, name in enumerate(("low", "high"))),
        ),
        "lines",
        compression="zstd",
    )
    discard(hashed)
    place = F.struct("doc_id", "pos", "key")
    firsts = lines.groupBy("line").agg(
        F.min(place).alias("place"), *(F.first(c).alias(c) for c in ("n", "low", "high", "steps"))
    )
    firsts = settle(firsts.select("line", "place.*", "n", "low", "high", "steps"), "firsts", compression="zstd")
    slim = settle(lines.select("doc_id", "key", "pos", "line"), "line-places", compression="zstd")
    first_places = settle(firsts.select("line", "doc_id", "key", "pos"), "first-places", compression="zstd")
    discard(lines)
    index = []
    for part in range(SLICES):
        index.append(_shared_steps(firsts, part, percent))
        collect_garbage(docs.sparkSession)
    discard(firsts)
    firsts = first_places
    small = (part.filter("NOT large").selectExpr("line AS a_line", "other AS b_line", "apart") for part in index)
    large = [part.filter("large").drop("other", "apart") for part in index]
    pairs = settle(reduce(DataFrame.unionByName, small).distinct(), "small-pairs", compression="zstd")
    some = reduce(DataFrame.unionByName, (_some_partners(part, percent) for part in large))
    nearest = F.min(F.struct("apart", "b_line")).alias("nearest")
    tried = pairs.unionByName(some).groupBy("a_line").agg(nearest).select("a_line", F.col("nearest.b_line").alias("b_line"))
    tried = settle(tried, "pairs", compression="zstd")
    first = _matched(tried, firsts, rows, percent)
    open_lines = (_all_partners(part, part.join(first, "line", "left_anti"), percent) for part in large)
    more = reduce(DataFrame.unionByName, open_lines, pairs).select("a_line", "b_line").distinct()
    more = more.join(tried, ["a_line", "b_line"], "left_anti").join(first, F.col("a_line") == first["line"], "left_anti")
    more = settle(more, "pairs", compression="zstd")
    discard(pairs, tried, *index)
    matched = first.unionByName(_matched(more, firsts, rows, percent))
    discard(more)

    least = firsts.select("line", F.struct("doc_id", "pos", "key").alias("least"))
    copies = slim.join(least, "line").filter(place != F.col("least"))
    near = slim.join(matched, "line", "left_semi")
    return copies.select("doc_id", "key", "pos").unionByName(near.select("doc_id", "key", "pos")).distinct()


def remove_lines(
    docs: DataFrame,
    percent: int = SIMILARITY_PERCENT,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with later matches cut out of the text, and ``lines_removed``, ``lines_total``.

    All columns and rows of ``docs`` stay (a column of one of the two new names is replaced).
    A null text stays null; a text that loses all its lines is empty.
    """
    gone = later_matches(docs, percent, min_words, id_col, text_col)
    gone = gone.groupBy(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key")).agg(
        F.collect_set("pos").alias("_gone")
    )
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    same = docs[id_col].cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text) == F.col("_gone_key"))
    kept = [c for c in docs.columns if c not in ("lines_removed", "lines_total")]
    split = F.split(F.col(text_col), "\n")
    cut = F.when(F.col("_gone").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.filter(split, lambda line, at: ~F.array_contains(F.col("_gone"), at)), "\n")
    )
    joined = docs.join(gone, same, "left")
    return joined.select(
        *(cut.alias(c) if c == text_col else F.col(c) for c in kept),
        F.coalesce(F.array_size("_gone"), F.lit(0)).alias("lines_removed"),
        F.coalesce(F.array_size(split), F.lit(1)).alias("lines_total"),
    )

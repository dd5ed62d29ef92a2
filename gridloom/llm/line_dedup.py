"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

A line is dropped when an equal one occurs earlier in the corpus (by doc_id, then row, then line
number; null ids first), or, if it has at least ``min_chars`` characters, when one within ``edits``
edits does. Lines of white space alone always stay.

1. Equal lines are one line, known by two 64-bit hashes: its first occurrence, combined before the
   shuffle, is written once with its text.
2. Every distinct line is cut into edits + 1 segments; two lines within ``edits`` edits share a
   whole segment of the shorter one. Each line brings its own segments as index keys and, for
   every length from its own down to ``edits`` less, the substrings that can equal a segment there
   given what the edits left and right of it allow (multi-match-aware selection).
3. Keys that only one line has are discarded; the texts of the few lines left are joined in.
4. Lines sharing a key are compared inside the join: letter counts first, then the banded
   bit-parallel edit distance. The join is a left semi join, so a bucket of m lines returns at
   most m rows, never its pairs; a bucket of more than ``block`` lines is dealt out in blocks.
5. Verdicts per line go back to the documents as one flag array each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Ids of lines to fetch are broadcast up to this many (8 bytes each), joined by shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Bound of the lines whose verdicts are broadcast.
HOT_LINES = 10_000
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment i (from 0) of ``parts`` of a line; the last ones are
    longer by one where it does not divide."""
    base, plain = F.floor(length / parts), parts - length % parts
    return F.lit(1) + base * i + F.greatest(F.lit(0), i - plain), base + F.when(i >= plain, 1).otherwise(0)


def _probes(edits: int) -> list[tuple[int, int, int, bool]]:
    """(less, segment, shift, index): how much shorter the other line is, which of its segments may
    stand here and by how much shifted; index: the line's own segment."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + edits - i)
            out += [(less, i, shift, less == 0 and shift == 0) for shift in range(low, high + 1)]
    return out


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(id, key, index) of (id, line, n characters): the line's own segments (index true) and the
    substrings with which it probes segments of lines no longer than itself."""
    probe = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("less", "i", "shift", "index"), p, strict=True)]) for p in _probes(edits)])
    each = lines.select("id", "line", "n", F.explode(probe).alias("p")).select("id", "line", "n", "p.*").withColumn("other", F.col("n") - F.col("less"))
    start, size = _segment(F.col("other"), F.col("i"), edits + 1)
    start = start + F.col("shift")
    inside = (start >= 1) & (start + size <= F.col("n") + 1)
    text = F.when(inside, F.substring("line", start.cast("int"), size.cast("int")))
    return each.select("id", F.xxhash64("other", "i", text).alias("key"), "index")


def characters(line: str) -> Column:
    """Array of the line's characters, those beyond the first plane whole."""
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def bit(condition: Column, place: int) -> Column:
    return F.when(condition, F.lit(1 << place).cast("long")).otherwise(F.lit(0).cast("long"))


def edit_distance_within(a: Column, b: Column, edits: int) -> Column:
    """Whether two arrays of characters are within ``edits`` edits (at least that long both).

    Bit-parallel over the band of 2 * edits + 1 diagonals, a machine word per column: bit d of a
    word stands for row j - edits + d of column j. First the distance is followed down the band's
    lowest diagonal to the last row of a, then along that row."""
    width = 2 * edits + 1
    mask = F.lit((1 << width) - 1).cast("long")
    la, lb = F.size(a), F.size(b)

    def flip(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(mask)

    def step(s: Column, j: Column) -> Column:
        char = F.get(b, j - 1)
        match = F.lit(0).cast("long")
        for d in range(width):
            match = match.bitwiseOR(bit(F.coalesce(F.get(a, j - edits + d - 1) == char, F.lit(False)), d))

        def vertical(word: Column) -> Column:
            vp, vn, pm = word.vp, word.vn, word.pm
            d0 = ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(mask)
            hp = vn.bitwiseOR(flip(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            return F.struct(d0.alias("d0"), hp.alias("hp"), hn.alias("hn"), word.dist.alias("dist"))

        def horizontal(word: Column) -> Column:
            down = F.shiftrightunsigned(word.d0, 1)
            vp = word.hn.bitwiseOR(flip(down.bitwiseOR(word.hp)))
            vn = down.bitwiseAND(word.hp)
            diagonal = F.lit(1) - F.shiftrightunsigned(word.d0, width - 1).bitwiseAND(F.lit(1)).cast("int")
            row = F.greatest(F.lit(0), la - j + edits)  # bit of a's last row in column j
            along = F.call_function("getbit", word.hp, F.least(row, F.lit(63))).cast("int") - F.call_function("getbit", word.hn, F.least(row, F.lit(63))).cast("int")
            return F.struct(vp.alias("vp"), vn.alias("vn"), (word.dist + F.when(j <= la - edits, diagonal).otherwise(along)).alias("dist"))

        word = F.transform(F.array(F.struct(s.vp.alias("vp"), s.vn.alias("vn"), match.alias("pm"), s.dist.alias("dist"))), vertical)
        return F.element_at(F.transform(word, horizontal), 1)

    first = F.struct(F.lit(((1 << width) - 1) ^ ((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).alias("dist"))
    return (F.abs(la - lb) <= edits) & (F.aggregate(F.sequence(F.lit(1), lb), first, step, lambda s: s.dist) <= edits)


#: What a line must hold to be judged at all.
SOMETHING = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, at, id, id2, line) of every line that holds something; row tells rows of one
    id apart by their text."""
    lines = docs.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).filter(F.col("line").rlike(SOMETHING))
    return lines.select("row", "doc_id", "at", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), F.col("line")).alias("id2"), "line")


def _code(of: str) -> Column:
    """A line's id without its last bit; it only brings lines together that are then compared whole."""
    return F.shiftright(of, 1)


def _dealt(shared: DataFrame, block: int) -> DataFrame:
    """Rows of (key, code, index) with the block that each lies in and those it is to meet."""
    sizes = shared.groupBy("key").agg(F.ceil(F.count("*") / block).alias("g")).filter("g > 1")
    placed = shared.join(sizes, "key", "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("code", F.lit(3)), F.col("g")))
    return placed.withColumn("others", F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).drop("g")


def near_lines(lines: DataFrame, *, edits: int, min_chars: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(firsts, near) of (row, doc_id, at, id, id2, line): each distinct line's first place and number,
    and the lines (id, id2) that are within ``edits`` edits of another that comes earlier."""
    length = F.length("line")
    texts = F.when(length >= min_chars, F.col("line"))
    firsts = written(lines.groupBy("id", "id2").agg(F.min(F.struct("doc_id", "row", "at")).alias("first"), F.count("*").alias("n"), F.first(texts).alias("line")), "line-firsts", compression="zstd")
    rows = segment_keys(firsts.filter("line is not null").select("id", "line", length.alias("n")), edits)
    bucket = Window.partitionBy("key")
    # 63 bits of the id and index in one long: two numbers a row are shuffled
    marks = rows.select("key", (F.shiftleft(_code("id"), 1) + F.col("index").cast("long")).alias("mark"))
    met = marks.withColumn("lo", F.min("mark").over(bucket)).withColumn("hi", F.max("mark").over(bucket)).withColumn("any", F.bit_or("mark").over(bucket))
    met = met.filter((_code("lo") != _code("hi")) & (F.col("any") % 2 != 0))
    shared = written(met.select("key", _code("mark").alias("code"), (F.col("mark") % 2 != 0).alias("index")), "line-keys")
    ids = shared.select("code").distinct()
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    counts = F.array(*[length - F.length(F.replace("line", F.lit(c), F.lit(""))) for c in _LETTERS])
    found = written(firsts.filter("line is not null").withColumn("code", _code("id")).join(wanted, "code", "left_semi").select("code", "id", "id2", "first", length.alias("chars"), "line", counts.alias("letters")), "line-texts")
    dealt = written(_dealt(shared, block), "line-dealt")
    x = dealt.select("key", "code", "index", F.explode("others").alias("meets")).join(found, "code")
    y = dealt.select("key", "code", "index", "own").join(found, "code")
    y = y.select(*[F.col(c).alias(f"{c}_y") for c in y.columns])
    apart = F.aggregate(F.zip_with("letters", "letters_y", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v)
    cond = (
        (F.col("key") == F.col("key_y"))
        & (F.col("meets") == F.col("own_y"))
        & (F.col("index") | F.col("index_y"))
        & (F.col("first_y") < F.col("first"))
        & (F.abs(F.col("chars") - F.col("chars_y")) <= edits)
        & (apart <= 2 * edits)
        & F.element_at(F.transform(F.array(F.struct(characters("line").alias("a"), characters("line_y").alias("b"))), lambda w: edit_distance_within(w.a, w.b, edits)), 1)
    )
    near = x.join(y, cond, "left_semi").select("id", "id2").distinct()
    return firsts.select("id", "id2", "first", "n"), near


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 16, block: int = 4096) -> DataFrame:
    """The rows of docs with their repeated lines taken out of the text, all columns kept, and
    n_lines, n_dropped (columns of these names in docs give way to them).

    Lines are parted by newline and compared exactly as written; those shorter than ``min_chars``
    characters go only if an equal one comes earlier, those of white space alone always stay. A
    null text stays null with 0 lines; an empty text is one line and stays; a text that loses
    every line becomes empty. Rows that repeat id and text are one document and come out alike.
    Empty table: no rows.
    """
    if min_chars <= edits:
        raise ValueError("a line must be longer than the edits it may take")
    docs = docs.drop("n_lines", "n_dropped")
    work = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[id_col], docs[text_col]).alias("row"))
    lines = _lines(work)
    firsts, near = near_lines(lines, edits=edits, min_chars=min_chars, block=block)
    verdicts = written(firsts.join(near.withColumn("near", F.lit(True)), ["id", "id2"], "left"), "line-verdicts")
    judged = _judged(lines.select("row", "doc_id", "at", "id", "id2", F.struct("doc_id", "row", "at").alias("place")), verdicts)
    dropped = judged.filter("drop").groupBy("doc_id", "row").agg(F.collect_set("at").alias("__line_gone"))
    flags = dropped.select(F.col("doc_id").alias("__line_doc"), F.col("row").alias("__line_row"), "__line_gone")
    marked = docs.withColumn("__line_own", F.xxhash64(docs[id_col], docs[text_col]))
    tagged = marked.join(flags, (F.col("__line_own") == F.col("__line_row")) & F.col("__line_doc").eqNullSafe(marked[id_col]), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    n = F.coalesce(F.size(parts), F.lit(0))
    kept = F.array_join(F.zip_with(parts, _marks(F.col("__line_gone"), F.size(parts)), lambda line, gone: F.when(~gone, line)), "\n")
    columns = [F.when(F.col("__line_gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return tagged.select(*columns, F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.coalesce(F.size("__line_gone"), F.lit(0)).cast("long").alias("n_dropped"))


def _judged(each: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(doc_id, row, at, drop) of all occurrences. Lines that make up more than one in HOT_LINES of all
    occurrences, of which there are fewer than HOT_LINES, are broadcast; the others meet by a
    shuffle on the line, in which the occurrences of hot ones are spread by row."""
    total = verdicts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(100, total // HOT_LINES)
    hot = verdicts.filter(F.col("n") > limit).select(F.col("id").alias("hot_id"), F.col("id2").alias("hot_id2"), F.col("first").alias("hot_first"), F.col("near").alias("hot_near"))
    cold = verdicts.filter(F.col("n") <= limit).select(F.col("id").alias("key"), F.col("id2").alias("key2"), "first", "near")
    found = each.join(F.broadcast(hot), (F.col("id") == F.col("hot_id")) & (F.col("id2") == F.col("hot_id2")), "left")
    plain = F.col("hot_id").isNull()
    keyed = found.withColumn("key", F.when(plain, F.col("id")).otherwise(F.xxhash64("row", "at", "id"))).withColumn("key2", F.when(plain, F.col("id2")))
    first, near = F.coalesce("hot_first", "first"), F.coalesce("hot_near", F.when(plain, F.col("near")), F.lit(False))
    return keyed.join(cold, ["key", "key2"], "left").select("doc_id", "row", "at", (near | (F.col("place") != first)).alias("drop"))


def _marks(gone: Column, size: Column) -> Column:
    """Array of ``size`` booleans, true at the places in ``gone``: sorted places and gaps between
    them, so its cost follows the number of lines."""
    ends = F.array_sort(F.concat(gone, F.array(size)))
    starts = F.concat(F.array(F.lit(-1)), F.array_sort(gone))
    runs = F.zip_with(starts, ends, lambda a, b: F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True))))
    return F.slice(F.flatten(runs), F.lit(1), size)

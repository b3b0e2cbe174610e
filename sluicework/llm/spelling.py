"""Spelling variants: words one code point apart, found by PartEnum signatures.

A word's letters, with repeats, are a binary vector with one dimension for the first, second,
... occurrence of each letter. Words that differ by one inserted, deleted or replaced code
point have vectors at a Hamming distance of at most two. The dimensions are dealt by a digest
over ``parts`` parts; at a distance of two at most two parts differ, so two near words agree
in some choice of ``parts - 2`` parts. Each choice's projection is a signature: equal
signatures are joined and the candidates verified.

Anagrams share all their signatures, so a signature of a regular vocabulary can hold many
words. One that holds more than ``hot`` words is split without loss: a word is cut in three,
and of three pieces one edit leaves two as they are. Both words of a pair take part in the
class of the shorter one's length, so a word is in two classes with three piece keys in each.
"""

from __future__ import annotations

import itertools
import math
import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.session import cut_lineage

RUN = "A-Za-zÀ-ÿ"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, twice: int = 2, drop: int = 31) -> DataFrame:
    """(word, n): the words of at least ``least`` code points that occur ``twice`` or more often.

    A word is a maximal run of letters with A-Z in lower case. A run loses the code point
    ``h % length`` if ``drop`` divides h, the crc32 of ``<id>:<run>``. A null text has no
    words, a null id is the empty string.
    """
    runs = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{RUN}]{{{least},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    rows = rows.withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    rows = rows.select(F.when(F.col("h") % drop == 0, cut).otherwise(F.col("run")).alias("word"))
    return rows.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, though ``use`` names it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _of_part(part: int, parts: int) -> Callable[[Column, Column], Column]:
    return lambda a, m: F.when(F.pmod(m, F.lit(parts)) == part, a.bitwiseXOR(m)).otherwise(a)


def signatures(word: Column, parts: int = 4) -> Column:
    """The array of a word's signatures: one for each choice of all but two of ``parts`` parts."""

    def marks(letters: Column) -> Column:
        # Of sorted letters, the place behind the first equal one numbers the occurrence.
        return F.transform(letters, lambda c, i: F.xxhash64(c, i.cast("long") - F.array_position(letters, c)))

    def projections(held: Column) -> Column:
        return F.array(*[F.aggregate(held, F.lit(0).cast("long"), _of_part(p, parts)) for p in range(parts)])

    def projected(p: Column) -> Column:
        return F.array(*[F.xxhash64(F.lit(k), *[p[i] for i in c]) for k, c in enumerate(itertools.combinations(range(parts), parts - 2))])

    return _let(F.sort_array(F.split(word, "")), lambda s: _let(marks(s), lambda m: _let(projections(m), projected)))


def pieces(word: Column) -> Column:
    """The keys that split a hot signature: in each of two classes, what is left without one of three pieces."""
    size = F.length(word)

    def of_class(m: Column) -> list[Column]:
        a, c = F.floor(m / 3).cast("int"), F.floor(2 * m / 3).cast("int")

        def head(n: Column) -> Column:
            return F.substring(word, F.lit(1), n)

        def tail(n: Column) -> Column:
            return F.substring(word, size - n + 1, n)

        return [F.xxhash64(m, F.lit(0), head(c)), F.xxhash64(m, F.lit(1), head(a), tail(m - c)), F.xxhash64(m, F.lit(2), tail(m - a))]

    return F.array(*of_class(size), *of_class(size - 1))


def near_pairs(vocabulary: DataFrame, parts: int = 4, hot: int = 128) -> DataFrame:
    """``vocabulary`` (word, n; words distinct) to (a, n_a, b, n_b), a < b, for all pairs one code point apart."""
    signed = cut_lineage(vocabulary.select("word", "n", F.explode(signatures(F.col("word"), parts)).alias("signature")))
    large = signed.groupBy("signature").agg(F.count("*").alias("held")).where(F.col("held") > hot).select("signature", F.lit(True).alias("large"))
    placed = signed.join(large, "signature", "left")
    whole = F.array(F.lit(0).cast("long"))
    keyed = cut_lineage(placed.select("signature", F.explode(F.when(F.col("large"), pieces(F.col("word"))).otherwise(whole)).alias("piece"), "word", "n"))
    left, right = (keyed.withColumnsRenamed({"word": w, "n": f"n_{w}"}) for w in "ab")
    close = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, ["signature", "piece"]).where("a < b").where(close).select("a", "n_a", "b", "n_b").distinct()


def variants(vocabulary: DataFrame, ratio: int = 10, parts: int = 4, hot: int = 128) -> DataFrame:
    """``vocabulary`` (word, n) to (word, form, root, n, n_near, form_n).

    A word's form is its near word with the largest n, ties to the smallest in code-point
    order, if that n is at least ``ratio`` times the word's own. The root is where the forms
    lead to. An empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms could lead in a circle below a ratio of 2")
    vocabulary = cut_lineage(vocabulary.select("word", "n"))
    both = F.array(*[F.struct(F.col(x).alias("word"), F.struct((-F.col(f"n_{y}")).alias("less"), F.col(y).alias("near")).alias("best")) for x, y in ("ab", "ba")])
    ways = near_pairs(vocabulary, parts, hot).select(F.explode(both).alias("way")).select("way.*")
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    found = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    found = cut_lineage(found)
    return found.join(_roots(found, ratio), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(found: DataFrame, ratio: int) -> DataFrame:
    """(word, root) of the words with a form. A step multiplies n by ``ratio``, so the largest n bounds the steps, and each round doubles the steps taken."""
    steps = found.where("form is not null").select("word", F.col("form").alias("root"))
    most = found.agg(F.max("n").alias("n")).first().n or 1
    longest = math.floor(math.log(most, ratio)) + 1

    def doubled(ways: DataFrame, _: int) -> DataFrame:
        ways = cut_lineage(ways)
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        return ways.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))

    return reduce(doubled, range(math.ceil(math.log2(longest))), steps)


# The same in SQL: replaced code points share a pattern with a gap, a deleted one leaves the shorter word.
ORACLE = r"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
x AS (SELECT doc_id, run, count(*) AS c, hex(encode(doc_id || ':' || run)) AS h FROM r GROUP BY ALL),
y AS (SELECT run, c, list_transform(range(len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bytes FROM x),
z AS (SELECT run, c, CAST(xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT) AS h FROM y, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM z),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
p AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM i),
e AS (SELECT a.word, b.word AS near, b.n FROM p a JOIN p b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT p.word, v.word, v.n FROM p JOIN v ON p.rest = v.word UNION SELECT v.word, p.word, p.n FROM p JOIN v ON p.rest = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL"""

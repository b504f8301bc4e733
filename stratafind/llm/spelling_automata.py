"""Spelling variants by forward and backward automata (operator 13).

Words are counted over all documents. The distinct ones that are long and frequent enough, and the same ones read backwards,
are sorted and cut into blocks of consecutive words; each block becomes a minimal acyclic automaton whose edges carry numbers
that add up to a word's place in the block (a perfect hash). One difference between two words lies in the second half of the
one asked for, or in its first half. So a word's first half is walked exactly in the forward automata and its second half
completed with one error, and its second half is walked backwards exactly in the backward ones and the first half completed.
A word visits the blocks alone whose words can begin with the half that is exact; what both directions find counts once.

A block has a bounded number of words, its visitors are dealt into groups of bounded size, and the driver holds the first word
of each block and nothing else. A word takes the form of its most frequent near word, if that is frequent enough; roots follow
by doubling the way each round, and as n doubles at least with each form, there are few rounds.

Defined results: null and empty texts hold no words; texts are read whole; the id of a row without one is the empty string in
the checksum; repeated rows count each; ties of n go to the word that comes first in code-point order; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, groups_for, sliced, to_python

#: Runs of these, after A-Z became small letters.
RUN = re.compile("[a-zÀ-ÿ]+")
#: The checksum of one occurrence in so many takes a code point out.
NOISE = 97
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 5, 3, 2
#: Words of an automaton, and words that visit it in one group: bound a task's memory.
BLOCK_WORDS, VISITORS = 1 << 15, 1 << 16
#: Different words a task counts before it hands the counts on.
HELD_WORDS = 200_000


def occurrences(docs: DataFrame) -> DataFrame:
    """word, n: counts by task, to be added up."""

    def count(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in sliced(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(RUN.findall((text or b"").lower().decode())).items():
                    h = zlib.crc32(run.encode(), before)
                    if h % NOISE == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) >= LEAST_LENGTH:
                        held[run] += n
                if len(held) > HELD_WORDS:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    return to_python(docs, "doc_id", "text").mapInArrow(count, "word string, n long")


def words_of(docs: DataFrame) -> DataFrame:
    """word, n."""
    return occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def ranked(df: DataFrame, by: str, rank: str, rows: int) -> DataFrame:
    """df with the rank of each row, from 0, in the order of a distinct column: by range, with the counts of the ranges before."""
    dealt = cut_lineage(df.repartitionByRange(groups_for(rows, 4 * BLOCK_WORDS), by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    starts, before = [], 0
    for r in dealt.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a range
        starts.append((r["part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    return dealt.join(F.broadcast(offsets), part == F.col("_part")).withColumn(rank, F.col("_before") + place).drop("_at", "_part", "_before")


class Automaton:
    """Minimal acyclic automaton of sorted distinct words. Along a word the numbers of its edges add up to its place."""

    def __init__(self, words):
        self.final: list[bool] = []
        self.edges: list[dict] = []
        self.words: list[int] = []
        known: dict = {}
        path: list = [(False, {})]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                child = state(*path.pop())
                path[-1][1][last[len(path) - 1]] = child

        def state(final: bool, children: dict) -> int:
            key = (final, tuple(children.items()))
            if (found := known.get(key)) is not None:
                return found
            known[key] = new = len(self.final)
            at, edges = int(final), {}
            for char, child in children.items():
                edges[char] = (child, at)
                at += self.words[child]
            self.final.append(final)
            self.edges.append(edges)
            self.words.append(at)
            return new

        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            close(same)
            path += [(k == len(word) - 1, {}) for k in range(same, len(word))]
            last = word
        close(0)
        self.root = state(*path[0])

    def walk(self, state: int, number: int, rest: str):
        """State and number after rest, or None."""
        for char in rest:
            edge = self.edges[state].get(char)
            if edge is None:
                return None
            state, number = edge[0], number + edge[1]
        return state, number

    def near(self, exact: str, rest: str) -> set[int]:
        """Places of the words that are `exact` and then `rest` with one code point more, less or another."""
        found: set[int] = set()
        at = self.walk(self.root, 0, exact)

        def end(state: int, number: int, tail: str) -> None:
            reached = self.walk(state, number, tail)
            if reached and self.final[reached[0]]:
                found.add(reached[1])

        for k in range(len(rest) + 1):
            if at is None:
                break
            state, number = at
            for char, (child, step) in self.edges[state].items():
                end(child, number + step, rest[k:])
                if k < len(rest) and char != rest[k]:
                    end(child, number + step, rest[k + 1 :])
            if k < len(rest):
                end(state, number, rest[k + 1 :])
                at = self.walk(state, number, rest[k])
        return found


def halves(word: str, backward: bool) -> tuple[str, str]:
    """What is walked exactly and what is completed, in the direction of the automaton. word: as that automaton reads it."""
    at = len(word) // 2 if not backward else len(word) - len(word) // 2
    return word[:at], word[at:]


def near_pairs(vocabulary: DataFrame, rows: int) -> DataFrame:
    """number, near, near_n: each word's near words, once, both ways. vocabulary: word, n, number (place among all words)."""
    spark = vocabulary.sparkSession
    backward = ranked(vocabulary.select(F.reverse("word").alias("word"), "n", "number"), "word", "place", rows)
    both = vocabulary.withColumn("place", F.col("number")).withColumn("side", F.lit(0)).unionByName(backward.withColumn("side", F.lit(1)))
    sided = cut_lineage(both.select("side", F.floor(F.col("place") / BLOCK_WORDS).cast("int").alias("block"), "place", "word", "n", "number"))
    firsts: dict = defaultdict(list)
    for r in sided.where(F.col("place") % BLOCK_WORDS == 0).select("side", "place", "word").orderBy("side", "place").collect():  # one word a block
        firsts[r["side"]].append(r["word"])

    def visit(batches):
        import pyarrow as pa

        for b in batches:
            out: list = [[], [], [], []]
            for side, word, number in zip(*(b.column(k).to_pylist() for k in range(3))):
                exact = halves(word, side == 1)[0]
                # blocks from the one that may hold the exact half itself to the last that begins with it or before it
                low = max(0, bisect_right(firsts[side], exact) - 1)
                high = bisect_left(firsts[side], exact[:-1] + chr(ord(exact[-1]) + 1)) - 1
                for block in range(low, high + 1):
                    for column, x in zip(out, (side, block, word, number)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names=["side", "block", "word", "number"])

    visits = sided.select("side", "word", "number").mapInArrow(visit, "side int, block int, word string, number long")
    # a block that many words visit is searched in several groups
    groups = cut_lineage(visits.groupBy("side", "block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("groups")))
    asked = visits.join(groups, ["side", "block"]).withColumn("grp", F.pmod(F.xxhash64("number"), F.col("groups")))
    held = sided.join(groups, ["side", "block"]).withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))

    def search(asked, held):
        import pyarrow as pa

        held = held.sort_by("place")
        automaton, numbers, counts = Automaton(held.column("word").to_pylist()), held.column("number").to_pylist(), held.column("n").to_pylist()
        out: list = [[], [], []]
        for side, word, number in zip(*(asked.column(c).to_pylist() for c in ("side", "word", "number"))):
            for k in automaton.near(*halves(word, side == 1)):
                for column, x in zip(out, (number, numbers[k], counts[k])):
                    column.append(x)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["number", "near", "near_n"])

    key = ("side", "block", "grp")
    found = asked.select(*key, "word", "number").groupBy(*key).cogroup(held.select(*key, "place", "word", "n", "number").groupBy(*key)).applyInArrow(search, "number long, near long, near_n long")
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """number, root for each row of number, form: the last word that forms lead to."""
    way, left = cut_lineage(forms.select("number", F.col("form").alias("root"))), -1
    while True:
        on = way.select(F.col("number").alias("at"), F.col("root").alias("further"))
        way = cut_lineage(way.join(on, F.col("root") == F.col("at"), "left").select("number", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        left = way.where("moved").limit(1).count()
        way = way.drop("moved")
        if not left:
            return way


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    counted = cut_lineage(words_of(docs))
    rows = counted.count()
    vocabulary = cut_lineage(ranked(counted, "word", "number", rows))
    pairs = near_pairs(vocabulary, rows)
    best = cut_lineage(pairs.groupBy("number").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("before"))).alias("best")))
    near = vocabulary.join(best, "number", "left").select("number", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("best.near_n") >= FORM_TIMES * F.col("n"), F.struct((-F.col("best.before")).alias("form"), F.col("best.near_n").alias("form_n"))).alias("to"))
    near = cut_lineage(near.select("number", "word", "n", "n_near", "to.form", "to.form_n"))
    word = vocabulary.select(F.col("number").alias("at"), F.col("word").alias("named"))
    led = near.join(roots(near.where("form IS NOT NULL").select("number", "form")), "number", "left")
    named = led.join(word.withColumnRenamed("named", "form_word"), F.col("form") == F.col("at"), "left").drop("at").join(word.withColumnRenamed("named", "root_word"), F.col("root") == F.col("at"), "left")
    return named.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")

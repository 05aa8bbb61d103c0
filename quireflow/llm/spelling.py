"""Spelling variants: words one edit apart, found by merging errata tries, and the form that each word goes back to.

Words stand in a trie. Two words are one edit apart exactly when, at the node where they part, the rest of one equals the
rest of the other once a character of one or of each is skipped. So each node's subtrees are merged with that character
skipped or replaced, and terminals that coincide give the pairs, each once. The child with most words is the heavy one
and is never walked: the light subtrees are laid over it (and over the node itself, for a skipped character) and walked
only as long as both go on, so a word is walked once for each light edge above it, of which there are at most log2 of
the number of words.

The top of the trie is merged by Spark: the light words of nodes with more than LIMIT words look up, by an equi-join on
whole words, what they become with their character replaced by the heavy one, skipped, or preceded by the heavy one, and
light words meet in groups by what remains of them, of one word for each character at most. Below, a task merges all
nodes of a subtree at once, level by level, as sorted arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, release

#: Fixed values of the contract.
RUN, EVERY, SHORTEST, LEAST, TIMES = r"[A-Za-zÀ-ÿ]", 31, 7, 2, 10
#: Words of a subtree that one task merges, the most large nodes at a depth, and levels that are counted at once.
LIMIT, MOST_LARGE, LEVELS = 10_000, 20_000, 4


def _from(text: Column, place: Column, end: Column | None = None) -> Column:
    """text from a place (counted from 0) on, or to before the place end."""
    return F.substr(text, place + 1, F.length(text) if end is None else end - place)


def written_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, every: int = EVERY) -> DataFrame:
    """word: each run of letters as it is taken, one row for each time it stands in a text.

    Only A-Z are lower-cased. Of a run whose checksum `every` divides, one character is left out. Runs shorter than
    `shortest` cannot become words and are left out at once.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    run = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{RUN}{{{shortest},}}"), F.lit(0)))
    low = docs.select(name.alias("name"), run.alias("run")).select("name", lower_ascii(F.col("run")).alias("run"))
    sums = low.select("run", F.crc32(F.concat("name", F.lit(":"), "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substr("run", F.lit(1), place), _from(F.col("run"), place + 1))).otherwise(F.col("run"))
    return sums.select(word.alias("word")).filter(F.length("word") >= shortest)


def _children(v: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the nodes v its children: whose they are (a place in v), and their numbers."""
    k = n[v]
    whose = np.repeat(np.arange(len(v)), k)
    return whose, np.repeat(first[v] - (np.cumsum(k) - k), k) + np.arange(len(whose))


class ErrataTrie:
    """The trie of sorted distinct words from a depth on. Node 0 is the root; nodes are numbered level by level."""

    def __init__(self, words: list[str], depth: int):
        points = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4") for w in words]
        length = np.array([len(p) for p in points], np.int64)
        begin = np.cumsum(length) - length
        flat = np.concatenate([*points, np.zeros(0, "<u4")]).astype(np.int64)
        node = np.zeros(len(words), np.int64)
        parents, chars, sizes, ends = [np.array([-1])], [np.array([0])], [np.array([len(words)])], [np.full(1, -1)]
        whole, total = np.arange(len(words)), 1
        ends[0][node[whole[length[whole] == depth]]] = whole[length[whole] == depth]
        whole = whole[length[whole] > depth]
        while len(whole):
            char = flat[begin[whole] + depth]
            new = np.append(True, (node[whole][1:] != node[whole][:-1]) | (char[1:] != char[:-1]))
            at = np.flatnonzero(new)
            parents.append(node[whole][at])
            chars.append(char[at])
            sizes.append(np.diff(np.append(at, len(whole))))
            node[whole] = total + np.cumsum(new) - 1
            depth += 1
            last = length[whole] == depth
            ends.append(np.full(len(at), -1))
            ends[-1][node[whole[last]] - total] = whole[last]
            total += len(at)
            whole = whole[~last]
        self.parent, self.char, self.size, self.end = map(np.concatenate, (parents, chars, sizes, ends))
        self.key = self.parent << 21 | self.char
        self.n = np.bincount(self.parent[1:], minlength=total)
        self.first = 1 + np.cumsum(self.n) - self.n

    def child(self, v: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node by a character, -1 where there is none or v is -1."""
        want = v << 21 | char
        at = np.minimum(np.searchsorted(self.key[1:], want) + 1, len(self.key) - 1)
        return np.where((v >= 0) & (self.key[at] == want) & (at > 0), at, -1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Words one edit apart, as places in the list, each pair once."""
        if len(self.key) == 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.lexsort((-self.size[1:], self.parent[1:])) + 1
        top = np.append(True, self.parent[order][1:] != self.parent[order][:-1])
        heavy = np.full(len(self.key), -1)
        heavy[self.parent[order][top]] = order[top]
        light = np.sort(order[~top])
        found = [*self._replaced(light, heavy), *self._skipped(light, heavy)]
        a, b = (np.concatenate(x) for x in zip(*found))
        return a, b

    def _replaced(self, light: np.ndarray, heavy: np.ndarray):
        """Each node's light subtrees merged into one errata trie, laid over the heavy one: their first characters differ."""
        trie, base = np.unique(self.parent[light], return_inverse=True)
        over = heavy[trie]
        while len(light):
            # terminals that coincide: light with heavy, light with light
            ended = self.end[light] >= 0
            t, w = base[ended], self.end[light[ended]]
            h = np.where(over[t] >= 0, self.end[over[t]], -1)
            yield w[h >= 0], h[h >= 0]
            step = 1
            while len(t) > step and (same := t[step:] == t[:-step]).any():
                yield w[step:][same], w[:-step][same]
                step += 1
            # one character on: errata nodes that hold two light nodes, or one over a heavy one
            whose, light = _children(light, self.first, self.n)
            key, base = np.unique(base[whose] << 21 | self.char[light], return_inverse=True)
            over = self.child(over[key >> 21], key & ((1 << 21) - 1))
            keep = (np.bincount(base, minlength=len(key)) > 1) | (over >= 0)
            light, base = light[keep[base]], base[keep[base]]
            order = np.argsort(base, kind="stable")
            light, base = light[order], (np.cumsum(keep) - 1)[base[order]]
            over = over[keep]

    def _skipped(self, light: np.ndarray, heavy: np.ndarray):
        """A light subtree over the node itself, its character skipped; the node's light part over its heavy subtree."""
        v = self.parent[1:]
        both = (self.end[1:] >= 0) & (self.end[v] >= 0)
        yield self.end[1:][both], self.end[v[both]]
        whose, a = _children(light, self.first, self.n)
        first_char = self.char[light][whose] != self.char[a]  # else the words part further down
        a, over = a[first_char], self.parent[light][whose][first_char]
        over = self.child(over, self.char[a])
        own = heavy[self.parent[light]]
        a, over = np.append(a, light), np.append(over, self.child(own, self.char[light]))
        while len(a):
            a, over = a[over >= 0], over[over >= 0]
            both = (self.end[a] >= 0) & (self.end[over] >= 0)
            yield self.end[a[both]], self.end[over[both]]
            whose, a = _children(a, self.first, self.n)
            over = self.child(over[whose], self.char[a])


def _merged(prefix: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one subtree, whose words share the prefix."""
    words = sorted(rows["word"])
    a, b = ErrataTrie(words, len(prefix[0])).pairs()
    return pd.DataFrame({"a": [words[k] for k in a], "b": [words[k] for k in b]}, dtype=object)


def _prefix(depth: Column) -> Column:
    return F.substr(F.col("word"), F.lit(1), depth)


def large_nodes(words: DataFrame, limit: int) -> DataFrame:
    """prefix, heavy: nodes of the words' trie with more than `limit` words, and the character of their heavy child.

    A few levels are counted at once, and further ones only below nodes that are still large.
    """
    found, low, open_ = None, 0, words.select("word")
    while True:
        depths = F.sequence(F.lit(low), F.least(F.length("word"), F.lit(low + LEVELS)))
        counts = open_.select(F.explode(F.when(F.length("word") >= low, depths)).alias("depth"), "word").groupBy(_prefix(F.col("depth")).alias("prefix")).agg(F.count("*").alias("size"))
        counts = cut(counts)
        parent = F.expr("substring(prefix, 1, length(prefix) - 1)")
        child = F.struct("size", F.right("prefix", F.lit(1)).alias("char"))
        heavy = counts.filter(F.length("prefix") > low).groupBy(parent.alias("prefix")).agg(F.max(child)["char"].alias("heavy"))
        large = counts.filter((F.col("size") > limit) & (F.length("prefix") < low + LEVELS)).select("prefix")
        large = large.join(heavy, "prefix")
        found = large if found is None else found.unionByName(large)
        low += LEVELS
        deeper = counts.filter((F.col("size") > limit) & (F.length("prefix") == low)).select("prefix")
        if deeper.isEmpty():
            return cut(found)
        open_ = open_.withColumn("prefix", _prefix(F.lit(low))).join(F.broadcast(deeper), "prefix", "left_semi").select("word")


def near_words(words: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """words (word, distinct) -> a, b: words one inserted, deleted or replaced code point apart, each pair once.

    A task's subtree has at most `limit` words, or one in MOST_LARGE of all, so large nodes are at most MOST_LARGE at a
    depth and can be broadcast.
    """
    words = words.filter("word is not null").select("word")
    large = large_nodes(words, max(limit, words.count() // MOST_LARGE))
    deepest = large.agg(F.max(F.length("prefix"))).first()[0]
    if deepest is None:
        return words.withColumn("prefix", F.substr("word", F.lit(1), F.lit(0))).groupBy("prefix").applyInPandas(_merged, "a string, b string")
    word, at = F.col("word"), F.col("depth")
    depths = words.select("word", F.explode(F.sequence(F.lit(0), F.least(F.length("word"), F.lit(deepest)))).alias("depth"))
    below = depths.withColumn("prefix", _prefix(at)).join(F.broadcast(large), "prefix").withColumn("char", _from(word, at, at + 1))
    before, rest, after = F.col("prefix"), _from(word, at), _from(word, at + 1)
    light = below.filter(F.col("char") != F.col("heavy"))
    # light words look up what they become; they and the words they meet are in the same node
    tries = F.array(
        F.when(F.col("char") != "", F.concat(before, "heavy", after)),
        F.when((F.col("char") != "") & (_from(after, F.lit(0), F.lit(1)) != F.col("char")), F.concat(before, after)),
        F.concat(before, "heavy", rest),
    )
    asked = light.select(word.alias("a"), F.explode(F.array_compact(tries)).alias("b"))
    answered = asked.join(words.select(word.alias("b")), "b").select("a", "b")
    skipped = light.filter("char <> ''").select("word", F.concat(before, F.lit("\0"), after).alias("skipped"))
    meets = skipped.groupBy("skipped").agg(F.array_sort(F.collect_list("word")).alias("ws")).filter(F.size("ws") > 1)
    meets = meets.select("ws", F.posexplode("ws").alias("k", "a")).select("a", F.explode(F.slice("ws", F.col("k") + 2, F.size("ws"))).alias("b"))
    # what hangs below the deepest large node of a word is merged by one task
    hung = below.groupBy("word").agg(F.max("depth").alias("depth")).filter(F.length("word") > at)
    merged = hung.select("word", _prefix(at + 1).alias("prefix")).groupBy("prefix").applyInPandas(_merged, "a string, b string")
    return merged.unionByName(answered).unionByName(meets)


def roots(links: DataFrame) -> DataFrame:
    """links (word, form), one form a word and no cycles -> word, root: the end of each word's chain of forms, in doubling steps."""
    reach = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = cut(reach.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reach = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return reach


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n: see the module. A word's form is its near word of largest n, smallest among equals, if that n is at least `times` the word's.

    Null and empty texts have no words; a null id counts as an empty one in the checksum; rows that repeat count as often
    as they stand there. Other columns are left out. An empty table has no words.
    """
    counts = written_words(docs, id_col=id_col, text_col=text_col, shortest=shortest).groupBy("word").agg(F.count("*").alias("n"))
    words = cut(counts.filter(F.col("n") >= least))
    pairs = cut(near_words(words, limit=limit))
    release(docs.sparkSession)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "b")).alias("best"))
    chosen = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    is_form = -F.col("best.minus") >= times * F.col("n")
    formed = cut(chosen.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.b")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")))
    ends = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Phrase collocations by weighted acyclic automata.

1. Documents are read in shards of some megabytes.  A shard's phrases of one to three words are counted and sorted, and
   added one block after the other to small automata that give each phrase its count (:mod:`textfacts.llm.automata`).
   A block is a range of prefixes: phrases go by a hash of their language and first two words, so that a very common
   first word, or a third of all text in one language, is spread over all ranges.
2. The automata of a range are united and their counts added up; what occurs too rarely is cut off.  With many shards
   this takes two or three rounds, each cutting a range into finer ones, so that the automata between the rounds stay as
   many as the shards times a constant.
3. The parts of a range's candidates (first words, last words, last pairs) are asked for at the ranges that hold them,
   once per range and part, and answered by composing the parts with the automaton there.  A part that is a phrase
   itself hears in the same way of the longer phrases that end in it.
4. Each range scores its candidates; the best of every language are taken from the best of every range.

Defined results: null texts are empty, null languages are ``und``; repeated rows count each; a language without
candidates gives no rows, nor does an empty table.  Only ``text`` and ``lang`` are read, other columns of any name are
ignored.  Bytes that no UTF-8 text has cannot occur; words may hold any other character, also NUL.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textfacts.llm.automata import (
    Automaton,
    Level,
    compose,
    merged_words,
    minimal,
    packed,
    pruned,
    trie,
    union,
    unpacked,
)
from textfacts.llm.common import gathered, table
from textfacts.session import materialise

LONGEST = 3  # words of a phrase
LEAST = 10
PER_LANG = 2000
LONGER_SHARE = 50  # per cent of a phrase's count at which a longer phrase stands for it
SCALE = 1_000_000
#: Text a task counts at a time, and text per final range.
SHARD_BYTES = 6 << 20
RANGE_BYTES = 12 << 20
#: Into how many ranges one round cuts at most.
FAN = 256
#: Slices a task hands on at a time.
SLICES_AT_ONCE = 16

_BREAK = 0xFF  # no byte of UTF-8 text
_BYTES = bytes(
    _BREAK if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def pieces_words(text: str | None) -> list[bytes]:
    """Lower-cased words, with a break mark between pieces."""
    return (text or "").encode("utf-8", "replace").translate(_BYTES).replace(b"\xff", b" \xff ").split()


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """32 bits of a hash over equally long columns of numbers."""
    state = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        state = (state ^ p.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(29)
    return (state * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.uint64, len(words))


def counted(texts: Iterable[str | None], langs: Iterable[str | None]) -> tuple[pa.Array, list[Level]]:
    """The trie of (language, up to three words) with counts, labels in byte order."""
    numbers = defaultdict()
    numbers.default_factory = numbers.__len__  # a new word gets the next number
    number = numbers.__getitem__
    number(b"\xff")
    lang_numbers: dict[bytes, int] = {}
    runs, of = [], []
    for text, lang in zip(texts, langs, strict=True):
        words = pieces_words(text)
        runs.append(np.fromiter(map(number, words), np.int32, len(words)))
        runs.append(np.zeros(1, np.int32))
        name = b"und" if lang is None else lang.encode("utf-8", "replace")
        of.append((lang_numbers.setdefault(name, len(lang_numbers)), len(words) + 1))
    token = np.concatenate([*runs, np.zeros(LONGEST, np.int32)])
    del runs
    lang = np.repeat(np.array([a for a, _ in of] + [0], np.int32), [n for _, n in of] + [LONGEST])
    names = pa.array([b"", *list(numbers)[1:]], pa.binary())  # the break mark has no label that is used
    words, (place, lang_place) = merged_words([names, pa.array(list(lang_numbers), pa.binary())])
    width = len(words)
    label = place.astype(np.int32)[token]
    at = np.flatnonzero(token != 0)
    key = lang_place[lang[at]] if len(at) else at
    levels = []
    prefix, node = np.unique(key, return_inverse=True)
    levels.append(Level(np.zeros(len(prefix), np.int64), prefix, np.zeros(len(prefix), np.int64)))
    for depth in range(LONGEST):
        if depth:
            goes_on = token[at + depth] != 0
            at, node = at[goes_on], node[goes_on]
        prefix, node, n = np.unique(node * width + label[at + depth], return_inverse=True, return_counts=True)
        levels.append(Level(prefix // width, prefix % width, n))
    while levels and not len(levels[-1].label):
        levels.pop()
    return words, levels


def _range_of(words: pa.Array, levels: list[Level], ranges: int) -> list[np.ndarray]:
    """The range of the nodes of each level from the words on: by language and at most two words."""
    h = _hashes(words)
    lang = h[levels[0].label]
    out = []
    prefix: list[np.ndarray] = [lang]
    for depth, level in enumerate(levels[1:]):
        if depth < 2:
            prefix = [*(p[level.parent] for p in prefix), h[level.label]]
            out.append(((_mixed(*prefix) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64))
        else:
            out.append(out[-1][level.parent])
    return out


def cut(words: pa.Array, levels: list[Level], ranges: int) -> Iterator[tuple[int, Automaton]]:
    """The minimal automaton of every range that has phrases."""
    if len(levels) < 2:
        return
    where = _range_of(words, levels, ranges)
    langs, uni, rest = levels[0], levels[1], levels[2:]
    # first words stand in their own range with their count, and without one wherever longer phrases begin with them
    nodes = np.arange(len(uni.label))
    starts = rest[0].parent if rest else np.zeros(0, np.int64)
    begun = where[1] if rest else starts
    key = np.concatenate([where[0], begun]) * len(nodes) + np.concatenate([nodes, starts])
    first, at = np.unique(key, return_inverse=True)
    weight = np.zeros(len(first), np.int64)
    weight[at[: len(nodes)]] = uni.weight
    first_range, first_node = first // len(nodes), first % len(nodes)
    in_lang = uni.parent[first_node]
    lang_key, lang_at = np.unique(first_range * len(langs.label) + in_lang, return_inverse=True)
    out = [Level(np.zeros(len(lang_key), np.int64), langs.label[lang_key % len(langs.label)], np.zeros(len(lang_key), np.int64))]
    out.append(Level(lang_at, uni.label[first_node], weight))
    lang_range = lang_key // len(langs.label)
    of_range = [lang_range, first_range]
    moved = at[len(nodes) :]  # the new parent of every pair
    for depth, level in enumerate(rest):
        parent = moved if depth == 0 else place[level.parent]
        order = np.lexsort((level.label, parent))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out.append(Level(parent[order], level.label[order], level.weight[order]))
        of_range.append(where[depth + 1][order])
    for r in np.unique(lang_range).tolist():
        mine, before = [], 0
        for level, spot in zip(out, of_range, strict=True):
            a, b = np.searchsorted(spot, [r, r + 1])
            if a == b:
                break
            mine.append(level.slice(a, b, before))
            before = a
        used, inverse = np.unique(np.concatenate([m.label for m in mine]), return_inverse=True)
        parts = np.split(inverse, np.cumsum([len(m.label) for m in mine])[:-1])
        yield r, minimal(words.take(pa.array(used)), [m._replace(label=p) for m, p in zip(mine, parts, strict=True)])


_SLICES = "place long, run long, automaton binary"


def _slice_batch(found: list[tuple[int, Automaton]], run: int) -> pa.RecordBatch:
    columns = [pa.array([r for r, _ in found], pa.int64()), pa.array([run] * len(found), pa.int64()), pa.array([packed(a) for _, a in found], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["place", "run", "automaton"])


def _automata(rows: pa.Table | pa.RecordBatch) -> list[Automaton]:
    return [unpacked(data) for data in rows.column("automaton").to_pylist()]


def shards(docs: DataFrame, ranges: int) -> DataFrame:
    """(place, run, automaton): each shard's counts, cut into ``ranges`` ranges; a shard is a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, part in enumerate(gathered(batches, limit=SHARD_BYTES), first):
            words, levels = counted(part.column("text").to_pylist(), part.column("lang").to_pylist())
            slices = cut(words, levels, ranges)
            while found := list(islice(slices, SLICES_AT_ONCE)):
                yield _slice_batch(found, number)

    return docs.select("text", "lang").mapInArrow(run, _SLICES)


def _recut(ranges: int, finer: int):
    """One round more: unite some runs of a range and cut it into finer ones."""

    def run(group: pa.Table) -> pa.Table:
        words, levels = union(_automata(group))
        number = group.column("run")[0].as_py()
        return pa.Table.from_batches([_slice_batch(list(cut(words, levels, finer)), number)])

    return run


_COUNTS_SCHEMA = pa.schema([("place", pa.int64()), ("automaton", pa.binary()), ("langs", pa.list_(pa.binary())), ("lang_words", pa.list_(pa.int64()))])
_COUNTS = "place long, automaton binary, langs array<binary>, lang_words array<long>"


def _united(least: int):
    """The last round: a range's counts without rare phrases, and its words by language."""

    def run(group: pa.Table) -> pa.Table:
        words, levels = union(_automata(group))
        total = np.zeros(len(levels[0].label), np.int64)
        np.add.at(total, levels[1].parent, levels[1].weight)
        kept = minimal(words, pruned(levels, least))
        langs = words.take(pa.array(levels[0].label)).to_pylist()
        columns = [group.column("place")[:1].combine_chunks(), pa.array([packed(kept)], pa.binary()), pa.array([langs], pa.list_(pa.binary())), pa.array([total.tolist()], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, schema=_COUNTS_SCHEMA)

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """A table of a row per range: the automaton of its phrases with at least ``least`` occurrences; and how many ranges."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    rounds = 1
    while ranges > FAN**rounds:
        rounds += 1
    fan = 1
    while fan**rounds < ranges:
        fan += 1
    rows = shards(docs, fan)
    for k in range(1, rounds):
        # a range's runs in groups of ``fan`` runs at the least, which after the cut are as many slices as before
        rows = rows.withColumn("run", F.pmod(F.xxhash64("run", F.lit(k)), F.lit(max(1, ranges // fan**k))))
        rows = rows.groupBy("place", "run").applyInArrow(_recut(fan**k, fan ** (k + 1)), _SLICES)
    return materialise(rows.drop("run").groupBy("place").applyInArrow(_united(least), _COUNTS), "phrase-counts"), fan**rounds


def _paths(automaton: Automaton) -> tuple[list[bytes], list[Level]]:
    words, levels = union([automaton])
    return words.to_pylist(), levels


def _phrases(words: list[bytes], levels: list[Level]) -> tuple[list[bytes], list[list[bytes]]]:
    """The language of each first-word node and the words of the nodes of every level after the languages."""
    out, lang = [], []
    for depth, level in enumerate(levels[1:]):
        if depth == 0:
            lang.append([words[levels[0].label[p]] for p in level.parent.tolist()])
            out.append([(words[i],) for i in level.label.tolist()])
        else:
            lang.append([lang[-1][p] for p in level.parent.tolist()])
            out.append([(*out[-1][p], words[i]) for p, i in zip(level.parent.tolist(), level.label.tolist(), strict=True)])
    return lang, out


def range_of_phrase(lang: list[bytes], phrases: list[tuple[bytes, ...]], ranges: int) -> np.ndarray:
    """Where phrases of one length are counted."""
    crc = lambda parts: np.fromiter(map(zlib.crc32, parts), np.uint64, len(parts))
    if not phrases:
        return np.zeros(0, np.int64)
    columns = [crc(lang), *(crc([p[k] for p in phrases]) for k in range(min(2, len(phrases[0]))))]
    return ((_mixed(*columns) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


_ASKED = pa.schema([("place", pa.int64()), ("asker", pa.int64()), ("lang", pa.binary()), ("part", pa.binary()), ("longer", pa.int64())])
_ASKED_SQL = "place long, asker long, lang binary, part binary, longer long"


def _asked(ranges: int):
    """The parts a range cannot look up itself, once each, with the largest count of a phrase that ends in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asker, automaton in zip(batch.column("place").to_pylist(), _automata(batch), strict=True):
                lang, phrases = _phrases(*(found := _paths(automaton)))
                levels = found[1][1:]
                wanted: dict[int, dict[tuple[bytes, tuple], int]] = {1: {}, 2: {}}
                for depth in range(1, len(levels)):
                    for tongue, phrase, a in zip(lang[depth], phrases[depth], levels[depth].weight.tolist(), strict=True):
                        if a:
                            wanted[1].setdefault((tongue, phrase[:1]), 0)
                            wanted[1].setdefault((tongue, phrase[-1:]), 0)
                            if depth == 2:
                                rest = tongue, phrase[1:]
                                wanted[2][rest] = max(wanted[2].get(rest, 0), a)
                for parts in wanted.values():
                    if parts:
                        tongues, shown = [t for t, _ in parts], [p for _, p in parts]
                        place = range_of_phrase(tongues, shown, ranges)
                        columns = [pa.array(place), pa.array([asker] * len(parts), pa.int64()), pa.array(tongues, pa.binary()), pa.array([b" ".join(p) for p in shown], pa.binary()), pa.array(list(parts.values()), pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, schema=_ASKED)

    return run


_ANSWER = pa.schema([("place", pa.int64()), ("lang", pa.binary()), ("part", pa.binary()), ("count", pa.int64()), ("longer", pa.int64())])
_ANSWER_SQL = "place long, lang binary, part binary, count long, longer long"


def _answered(asked: pa.Table, counts: pa.Table) -> pa.Table:
    """Compose the parts asked for with the range's automaton; tell the range of longer phrases."""
    if not asked.num_rows:
        return _ANSWER.empty_table()
    lang, part = asked.column("lang").to_pylist(), asked.column("part").to_pylist()
    keys = sorted(set(zip(lang, part, strict=True)))
    split = [(tongue, *p.split(b" ")) for tongue, p in keys]
    words = pa.array(sorted({w for s in split for w in s}), pa.binary())
    number = {w: i for i, w in enumerate(words.to_pylist())}
    sequences = [[number[w] for w in s] for s in split]
    wanted = trie(sequences, [0] * len(sequences))
    found = compose(words, wanted, _automata(counts)[0])
    node_of: dict[tuple, int] = {}
    known = []
    for level, weights in zip(wanted, found, strict=True):
        node_of = {(p, i): k for k, (p, i) in enumerate(zip(level.parent.tolist(), level.label.tolist(), strict=True))}
        known.append((node_of, weights))
    count = {}
    for key, sequence in zip(keys, sequences, strict=True):
        node = 0
        for depth, label in enumerate(sequence):
            node = known[depth][0][node, label]
        count[key] = int(known[len(sequence) - 1][1][node])
    longer: dict[tuple[bytes, bytes], int] = {}
    for tongue, p, a in zip(lang, part, asked.column("longer").to_pylist(), strict=True):
        if a:
            longer[tongue, p] = max(longer.get((tongue, p), 0), a)
    place = asked.column("place")[0].as_py()
    rows = [
        asked.column("asker").to_pylist() + [place] * len(longer),
        lang + [t for t, _ in longer],
        part + [p for _, p in longer],
        [count[k] for k in zip(lang, part, strict=True)] + [0] * len(longer),
        [0] * asked.num_rows + list(longer.values()),
    ]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ANSWER, strict=True)], schema=_ANSWER)


_SCORED = pa.schema([("place", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])
_SCORED_SQL = "place long, lang string, phrase string, a long, l long, r long, score long"


def _scored(per_lang: int, longer_share: int):
    """A range's best candidates of every language."""

    def run(answers: pa.Table, counts: pa.Table) -> pa.Table:
        if not counts.num_rows or not answers.num_rows:
            return _SCORED.empty_table()
        place = counts.column("place")[0].as_py()
        count, longest = {}, {}
        for tongue, part, c, a in zip(*(answers.column(n).to_pylist() for n in ("lang", "part", "count", "longer")), strict=True):
            if a:
                longest[tongue, part] = a
            else:
                count[tongue, part] = c
        words, levels = _paths(_automata(counts)[0])
        lang, phrases = _phrases(words, levels)
        best: dict[bytes, list[tuple]] = {}
        for depth in range(1, len(levels) - 1):
            weights = levels[depth + 1].weight.tolist()
            above = levels[depth].weight.tolist()
            parents = levels[depth + 1].parent.tolist()
            within = np.zeros(len(weights), np.int64)
            if depth == 1 and len(levels) > 3:
                np.maximum.at(within, levels[3].parent, levels[3].weight)
            for k, (tongue, phrase, a) in enumerate(zip(lang[depth], phrases[depth], weights, strict=True)):
                if not a:
                    continue
                whole = b" ".join(phrase)
                if depth == 1 and 100 * max(int(within[k]), longest.get((tongue, whole), 0)) >= longer_share * a:
                    continue
                cuts = []
                for size in range(1, depth + 1):
                    left = above[parents[k]] if size == 2 else count[tongue, phrase[0]]
                    right = count[tongue, b" ".join(phrase[size:])]
                    cuts.append((SCALE * a * a // (left * right), size, left, right))
                score, _, left, right = min(cuts)
                best.setdefault(tongue, []).append((-score, -a, whole, left, right))
        rows = []
        for tongue, found in best.items():
            found.sort()
            rows += [(place, tongue.decode(), whole.decode(), -a, left, right, -s) for s, a, whole, left, right in found[:per_lang]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCORED)], schema=_SCORED) if rows else _SCORED.empty_table()

    return run


def collocations(docs: DataFrame, least: int = LEAST, per_lang: int = PER_LANG, longer_share: int = LONGER_SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``per_lang`` phrases of each language."""
    counts, ranges = phrase_counts(docs, least)
    asked = counts.select("place", "automaton").mapInArrow(_asked(ranges), _ASKED_SQL)
    fields = counts.drop("langs", "lang_words")
    answers = asked.groupBy("place").cogroup(fields.groupBy("place")).applyInArrow(_answered, _ANSWER_SQL)
    found = answers.groupBy("place").cogroup(fields.groupBy("place")).applyInArrow(_scored(per_lang, longer_share), _SCORED_SQL)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    group = ranges
    while group > 1:  # the best of 64 groups at a time, until one task sees at most 64 times ``per_lang`` rows of a language
        group = -(-group // 64)
        window = Window.partitionBy("lang", "place").orderBy(*order)
        found = found.withColumn("place", F.col("place") % group).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= per_lang)
    if ranges == 1:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "place").orderBy(*order)))
    totals = (
        counts.select(F.inline(F.arrays_zip("langs", "lang_words")))
        .groupBy(F.col("langs").cast("string").alias("lang"))
        .agg(F.sum("lang_words").alias("n"))
    )
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase
  from split, (values (1), (2), (3)) as sizes(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as c from grams group by all),
n as (select lang, sum(c)::bigint as n from f where k = 1 group by lang),
cand as (select lang, k, phrase, string_split(phrase, ' ') as w, c as a from f where k > 1 and c >= 10),
cuts as (select lang, k, phrase, w, a, unnest(range(1, k)) as j from cand),
scored as (
  select t.lang, t.phrase, t.a, t.j, p.c as l, q.c as r,
         (1000000::hugeint * t.a * t.a // (p.c::hugeint * q.c))::bigint as score
  from cuts t
  join f p on p.lang = t.lang and p.k = t.j and p.phrase = array_to_string(t.w[1:t.j], ' ')
  join f q on q.lang = t.lang and q.k = t.k - t.j and q.phrase = array_to_string(t.w[t.j + 1:], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
longer as (
  select lang, part, max(a) as a from (
    select lang, array_to_string(w[1:2], ' ') as part, a from cand where k = 3
    union all select lang, array_to_string(w[2:3], ' '), a from cand where k = 3)
  group by lang, part),
kept as (
  select b.* from best b left join longer g on g.lang = b.lang and g.part = b.phrase
  where g.a is null or 100 * g.a < 50 * b.a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""

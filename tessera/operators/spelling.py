"""Queries put into the lexicon's words: characters that sound alike, and initials that stand for characters.

A walk from the left picks the longest match at each place. Up to BROADCAST_WORDS words are sent to all tasks, by the initials of their characters; the walk looks up the spans of
the places it comes to, longest first, and what a span may stand for, or what becomes of a short part of a query, is found once while it is remembered, so no span leaves a task.

More words are joined: spans of all queries, seven for each character, meet the lexicon by their key, the initials, so the lexicon may have any size and only spans with a
word of the same initials go on. Whether a span may stand for the word is found once for each batch's pairs of both. What remains for each query is a short list of
matches, through which the walk goes.

Initials and syllables are one character each in a text of the same length, by translation: ``syllables`` (char, syllable) has a row for a
character at most, and there are some thousand different ones, so the tables are part of the expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, MOST_LENGTH = 2, 8
#: Syllables are told apart by so many private characters.
_PRIVATE, _MOST_SYLLABLES, _MOST_CHARACTERS = 0xE000, 6400, 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD, _LETTERS = str.maketrans(_UPPER, _LOWER), frozenset(_UPPER + _LOWER)
_HAN = r"^[\x{4e00}-\x{9fff}]$"
#: More words than these are joined by a shuffle. A task remembers so many spans, and so many runs of at most so many characters.
BROADCAST_WORDS, REMEMBERED, SHORT_RUN = 1_000_000, 200_000, 24
RESULT = "text string, rewrites array<struct<span:string,term:string,kind:string>>"


class Sounds:
    """Translations of a text into initials and into syllables, from a table (char, syllable)."""

    def __init__(self, syllables: DataFrame):
        rows = syllables.where(F.col("char").rlike(_HAN) & (F.length("syllable") > 0)).groupBy("char").agg(F.min("syllable").alias("syllable")).orderBy("char").limit(_MOST_CHARACTERS).collect()
        kinds = {s: chr(_PRIVATE + i) for i, s in enumerate(sorted({r["syllable"] for r in rows}))}
        if len(kinds) > _MOST_SYLLABLES:
            raise ValueError(f"{len(kinds)} different syllables; {_MOST_SYLLABLES} can be told apart")
        self.chars = "".join(r["char"] for r in rows)
        self.firsts = "".join(r["syllable"][0].lower() for r in rows)
        self.codes = "".join(kinds[r["syllable"]] for r in rows)

    def tables(self) -> tuple[dict[int, str], dict[str, str]]:
        """Initials for str.translate(), and the syllable of each character."""
        return str.maketrans(dict(zip(self.chars + _UPPER, self.firsts + _LOWER, strict=False))), dict(zip(self.chars, self.codes, strict=True))

    def initials(self, text: Column) -> Column:
        return F.translate(text, self.chars + _UPPER, self.firsts + _LOWER)

    def syllables(self, text: Column) -> Column:
        return F.translate(text, self.chars, self.codes)


def _counts(span: str, term: str, syllables: dict[str, str]) -> int:
    """How many characters of the span are the initial of the word's, plus 16 for each that sounds like it; -1 if another one isn't the word's in either case. Initials of both are equal."""
    count = 0
    for got, want in zip(span, term, strict=True):
        if got != want and got.translate(_FOLD) != want.translate(_FOLD):
            has = want in syllables
            if has and got in _LETTERS:
                count += 1
            elif has and syllables.get(got) == syllables[want]:
                count += 16
            else:
                return -1
    return count


def _words(lexicon: DataFrame, sounds: Sounds) -> DataFrame:
    """Each word (term, freq, guard) of a lexicon once, with its key."""
    words = lexicon.where(F.length("term").between(LEAST_LENGTH, MOST_LENGTH)).groupBy("term").agg(F.max("freq").alias("freq"), F.min("guard").alias("guard"))
    return words.withColumn("key", sounds.initials(F.col("term")))


def lexicon_matches(queries: DataFrame, lexicon: DataFrame, sounds: Sounds) -> DataFrame:
    """(query_id, start, size, term, kind, changed, differs, freq) of spans of queries (query_id, query) that are words or guards of a lexicon (term, freq, guard), or may stand for a word.

    kind is 'known' for the former, whose term is null; ``changed`` counts the characters replaced, ``differs`` is the first place (from 0) at which span and word aren't the very same.
    """
    char = lambda text, i: F.substring(text, i + 1, F.lit(1) if isinstance(i, Column) else 1)
    words = _words(lexicon, sounds).persist()
    few = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    # What is taken out of a long text by place costs its length: once for each place, the characters of all its spans and one more at either side.
    whole = queries.where(F.length("query") >= LEAST_LENGTH).select("query_id", F.length("query").alias("_n"), F.concat(F.lit(" "), "query", F.lit(" ")).alias("_text"), sounds.initials(F.col("query")).alias("_initials"))
    starts = whole.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("_n") - LEAST_LENGTH)))
    starts = starts.select("query_id", "_n", "start", F.substring("_text", F.col("start") + 1, F.lit(MOST_LENGTH + 2)).alias("_near"), F.substring("_initials", F.col("start") + 1, F.lit(MOST_LENGTH)).alias("_keys"))
    spans = starts.withColumn("size", F.explode(F.sequence(F.lit(LEAST_LENGTH), F.least(F.lit(MOST_LENGTH), F.col("_n") - F.col("start")))))
    met = spans.select("query_id", "start", "size", "_near", F.substring("_keys", F.lit(1), F.col("size")).alias("key")).join(F.broadcast(words) if few else words, "key")
    met = met.withColumn("span", F.substring("_near", F.lit(2), F.col("size")))
    letter = lambda c: c.between("a", "z") | c.between("A", "Z")
    # Letters in a row are replaced together or not at all.
    cuts = (letter(char("_near", 0)) & letter(char("_near", 1))) | (letter(char("_near", F.col("size"))) & letter(char("_near", F.col("size") + 1)))
    same = F.col("span") == F.col("term")
    syllables = dict(zip(sounds.chars, sounds.codes, strict=True))

    @F.pandas_udf("int")
    def counted(spans: pd.Series, terms: pd.Series) -> pd.Series:
        # Far fewer different pairs than places.
        pairs = list(zip(spans, terms, strict=True))
        of = {pair: _counts(*pair, syllables) for pair in set(pairs)}
        return pd.Series([of[p] for p in pairs], dtype="int32")

    # Counted once: a filter on it must not repeat it.
    met = met.where(same | (~F.col("guard") & ~cuts)).select("query_id", "start", "size", "span", "term", "freq", counted.asNondeterministic()("span", "term").alias("_counts"))
    met = met.withColumn("initial", F.col("_counts") % 16).withColumn("sound", F.floor(F.col("_counts") / 16).cast("int"))
    changed = F.col("sound") + F.col("initial")
    allowed = (F.col("_counts") > 0) & (F.col("sound") <= F.greatest(F.lit(1), F.floor(F.col("size") / 2)))
    kind = F.when(same, "known").when((F.col("sound") > 0) & (F.col("initial") > 0), "mixed").when(F.col("initial") > 0, "abbr").otherwise("homophone")
    differs = reduce(lambda before, i: before.when(char("span", i) != char("term", i), i), range(1, MOST_LENGTH), F.when(char("span", 0) != char("term", 0), 0)).otherwise(F.col("size"))
    return met.where(same | allowed).select(
        "query_id", "start", "size", F.when(~same, F.col("term")).alias("term"), kind.alias("kind"), F.when(same, 0).otherwise(changed).alias("changed"),
        differs.alias("differs"), F.coalesce("freq", F.lit(0)).cast("long").alias("freq"),
    )


def _walk(query: str, matches: list[dict]) -> tuple[str, list[dict]]:
    """The query with its picks: at each place the longest match that reaches beyond what is already known to be right, and changes nothing of that."""
    by_start: dict[int, list[dict]] = {}
    for m in sorted(matches, key=lambda m: (-m["size"], m["kind"] != "known", m["changed"], -m["freq"], m["term"] or "")):
        by_start.setdefault(m["start"], []).append(m)
    out, rewrites, at, safe = [], [], 0, 0
    while at < len(query):
        pick = next((m for m in by_start.get(at, ()) if at + m["size"] > safe and (m["kind"] == "known" or m["differs"] >= min(safe - at, m["size"]))), None)
        if pick is None or pick["kind"] == "known":
            safe = max(safe, at + pick["size"]) if pick else safe
            out.append(query[at])
            at += 1
        else:
            out.append(pick["term"])
            rewrites.append({"span": query[at : at + pick["size"]], "term": pick["term"], "kind": pick["kind"]})
            at += pick["size"]
    return "".join(out), rewrites


def _look_up(span: str, terms: str, guards: frozenset[str], syllables: dict[str, str]) -> list[tuple[str | None, str, int]]:
    """(term, kind, first difference) of the words, one after the other in terms, for which a span may stand, in the order in which a walk picks them; the span itself is 'known' and has no term."""
    size, found = len(span), []
    for order, at in enumerate(range(0, len(terms), size)):
        term = terms[at : at + size]
        if term == span:
            found.append((False, 0, order, None, "known", size))
        elif term not in guards:
            count = _counts(span, term, syllables)
            sound, initial = divmod(count, 16)
            if count > 0 and sound <= max(1, size // 2):
                differs = next(i for i, (got, want) in enumerate(zip(span, term, strict=True)) if got != want)
                found.append((True, sound + initial, order, term, "mixed" if sound and initial else "abbr" if initial else "homophone", differs))
    return [(term, kind, differs) for *_, term, kind, differs in sorted(found, key=lambda f: f[:3])]


def _walk_run(query: str, initials: str, start: int, end: int, words: dict[str, str], guards: frozenset[str], syllables: dict[str, str], spans: dict[str, list]) -> tuple[str, list[dict]]:
    """What _walk() makes of a part of a query beyond which no match reaches; only matches of the places it comes to are looked up."""
    out, rewrites, at, safe = [], [], start, start
    while at < end:
        pick, longest = None, 0
        for size in range(min(MOST_LENGTH, end - at), max(LEAST_LENGTH, safe - at + 1) - 1, -1):
            terms = words.get(initials[at : at + size])
            if terms is None:
                continue
            span = query[at : at + size]
            found = spans.get(span)
            if found is None:
                if len(spans) >= REMEMBERED:
                    spans.clear()
                found = spans[span] = _look_up(span, terms, guards, syllables)
            if not found:
                continue
            # Letters in a row are replaced together or not at all.
            cuts = at and query[at - 1] in _LETTERS and span[0] in _LETTERS or at + size < len(query) and span[-1] in _LETTERS and query[at + size] in _LETTERS
            pick = next((f for f in found if f[0] is None or not cuts and f[2] >= min(safe - at, size)), None)
            if pick:
                longest = size
                break
        if pick is None or pick[0] is None:
            safe = max(safe, at + longest)
            out.append(query[at])
            at += 1
        else:
            out.append(pick[0])
            rewrites.append({"span": query[at : at + longest], "term": pick[0], "kind": pick[1]})
            at += longest
    return "".join(out), rewrites


def _walks(words: dict[str, str], guards: frozenset[str], runs: str, firsts: dict[int, str], syllables: dict[str, str]) -> Callable[[str], tuple[str, list[dict]]]:
    """_walk() of a query with all its matches. No match reaches beyond a run of characters of the words' keys, a pattern, so a query is cut into these; short ones are remembered with what decides them, the letters beside them."""
    spans: dict[str, list] = {}
    known: dict[tuple, tuple[str, list[dict]]] = {}
    parts = re.compile(runs)

    def walk(query: str) -> tuple[str, list[dict]]:
        initials, out, rewrites, done = query.translate(firsts), [], [], 0
        for part in parts.finditer(initials):
            start, end = part.span()
            beside = start > 0 and query[start - 1] in _LETTERS, end < len(query) and query[end] in _LETTERS
            key = (query[start:end], *beside)
            found = known.get(key)
            if found is None:
                found = _walk_run(query, initials, start, end, words, guards, syllables, spans)
                if end - start <= SHORT_RUN:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = found
            out += query[done:start], found[0]
            rewrites += found[1]
            done = end
        return "".join((*out, query[done:])), rewrites

    return walk


def normalize_queries(queries: DataFrame, lexicon: DataFrame, syllables: DataFrame) -> DataFrame:
    """query_id, query and RESULT of queries (query_id, query), by a lexicon (term, freq, guard: not to be changed, but no word to change to) and (char, syllable).

    A span may stand for a word of equal length if each of its characters is the word's (in either case of A-Z), the initial of the word's syllable, or of the same syllable, with
    at least one of the latter two, and sound-alikes in at most half of the word, or one. Words and guards themselves stay and protect their characters; of
    words of one length the one with the fewest changes is taken, then the most frequent. Null queries stay null; equal ids with different texts are taken as one query each.
    """
    sounds = Sounds(syllables)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, query string, {RESULT}"
    every = _words(lexicon, sounds).persist()
    if every.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        # The words of a key one after the other, the most frequent first.
        rows = every.select("key", "term", (F.col("guard") | F.col("guard").isNull()).alias("guard"), F.coalesce("freq", F.lit(0)).alias("freq")).toArrow().sort_by([("key", "ascending"), ("freq", "descending"), ("term", "ascending")])
        words: dict[str, str] = {}
        for key, term in zip(rows.column("key").to_pylist(), rows.column("term").to_pylist(), strict=True):
            words[key] = words.get(key, "") + term
        guards = frozenset(rows.filter(rows.column("guard")).column("term").to_pylist())
        every.unpersist()
        # Without words there is no run.
        runs = "[" + re.escape("".join(sorted({c for key in words for c in key}))) + "]{2,}" if words else "(?!)"
        sent = queries.sparkSession.sparkContext.broadcast((words, guards, runs, *sounds.tables()))

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            walk = _walks(*sent.value)
            for batch in batches:
                walked = [(None, []) if q is None else walk(q) for q in batch["query"]]
                yield pd.DataFrame({"query_id": batch["query_id"], "query": batch["query"], "text": [t for t, _ in walked], "rewrites": [r for _, r in walked]})

        return queries.select("query_id", "query").mapInPandas(look, schema)
    every.unpersist()
    # Matches carry a digest of their query, not its text.
    keyed = queries.select("query_id", "query").withColumn("_key", F.struct("query_id", F.sha2("query", 256).alias("digest")))
    found = lexicon_matches(keyed.select(F.col("_key").alias("query_id"), "query").distinct(), lexicon, sounds)
    # A query's own matches, as many as its spans have words.
    own = found.groupBy("query_id").agg(F.collect_list(F.struct("start", "size", "term", "kind", "changed", "differs", "freq")).alias("matches")).select(F.col("query_id").alias("_key"), "matches")
    rows = keyed.join(own, keyed["_key"].eqNullSafe(own["_key"]), "left").select("query_id", "query", "matches")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            walked = [(q, []) if q is None or m is None else _walk(q, list(m)) for q, m in zip(batch["query"], batch["matches"], strict=True)]
            yield pd.DataFrame({"query_id": batch["query_id"], "query": batch["query"], "text": [t for t, _ in walked], "rewrites": [r for _, r in walked]})

    return rows.mapInPandas(walk, schema)

"""What a few facts that touch one another do to the store, decided in their order.

Runs inside one task, over one component of a batch: its facts, each with the rows of the store that it may look at.
Nothing here reads the store or knows of other components.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import md5
from itertools import chain, islice
from typing import Any

import numpy as np

from factloom.functions.text import SINGLE_VALUED, SINGLE_VALUED_PREFIXES
from factloom.operators import lexical
from factloom.sources.judging import Judge, Ruling, usable_line

# Thresholds of cosines, rows looked at, subtypes whose facts describe a state, and the reasons told.
DUPLICATE, RELATED, SUPERSEDE = 0.985, 0.55, 0.88
EXACT, NEAR, LEXICAL, BY_NAME, CANDIDATES = 8, 5, 6, 6, 6
STATE_SUBTYPES = ("configuration", "project_state", "decision", "preference")
NOT_DURABLE, SECRET = "not durable", "looks like a secret"
SAME_WORDS, SAME_MEANING, SAME_JUDGED = "exact duplicate", "semantic duplicate", "judge: duplicate"
REPLACING, NEW, NO_JUDGE = "replaces outdated memory", "new durable memory", " (judge unavailable: {})"


@dataclass(frozen=True)
class Thresholds:
    duplicate: float = DUPLICATE
    related: float = RELATED
    supersede: float = SUPERSEDE

    def __post_init__(self) -> None:
        if not 0 <= self.related <= self.duplicate <= 1:
            raise ValueError("thresholds must satisfy 0 <= related <= duplicate <= 1")


def normalized(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def single_valued(predicate: str) -> bool:
    return predicate.lower() in SINGLE_VALUED or predicate.lower().startswith(SINGLE_VALUED_PREFIXES)


def hits(terms: list[str], text: str) -> int:
    """``functions.text.prefix_overlap`` of two texts of a batch: terms that begin a word, or that a word of four
    characters or more begins. Words are sorted once, so a term costs a search."""
    words = sorted(set(lexical.words_of(text)))

    def known(term: str) -> bool:
        stem = term[:-1] if len(term) > 4 and term[-1] == "s" else term
        for begin in chain([stem], (stem[:k] for k in range(4, len(stem)))):
            at = bisect_left(words, begin)
            if at < len(words) and (words[at].startswith(begin) if begin is stem else words[at] == begin):
                return True
        return False

    return sum(known(t) for t in terms)


@dataclass
class Told:
    """The outcome for one fact."""

    action: str
    reason: str
    memory_id: str | None = None
    replaced: tuple[str, ...] = ()


@dataclass
class Board:
    """The rows that a component's facts may look at, as the facts so far have left them."""

    at: str
    thresholds: Thresholds
    keep_history: bool
    judge: Judge | None
    embed: Callable[[str], list[float] | None]
    rows: dict[str, dict[str, Any]] = field(default_factory=dict)  # stored ones and new ones, by id
    fresh: list[str] = field(default_factory=list)  # ids of new ones, in order
    touched: dict[str, None] = field(default_factory=dict)
    units: dict[str, np.ndarray] = field(default_factory=dict)  # of new ones

    # -- looking ------------------------------------------------------------------
    def _held(self, evidence: Iterable[dict] | None) -> Iterator[dict]:
        """The rows of some evidence that are still active, as they are now."""
        for seen in evidence or ():
            row = self.rows.setdefault(seen["id"], {"names": (), **seen, "status": "active"})
            row["names"] = row["names"] or seen.get("names", ())  # only evidence of vectors has them
            if row["status"] == "active":
                yield row

    def _new(self) -> Iterator[dict]:
        return (self.rows[i] for i in reversed(self.fresh) if self.rows[i]["status"] == "active")

    def same_words(self, fact: dict) -> dict | None:
        own = (row for row in self._new() if row["key"] == fact["key"])
        return next(chain(own, self._held(fact["exact"])), None)

    def alike(self, fact: dict, most: int, floor: float) -> list[tuple[float, dict]]:
        """Cosine and row, best first. Of the store's rows only the best ``most`` are looked at, whatever became of them."""
        if fact["unit"] is None:
            return []
        stored = sorted(fact["near"] or (), key=lambda r: (r["similarity"], r["id"]))[-most:]
        scored = [(r["similarity"], row) for r in stored for row in self._held([r])]
        for row in self._new():
            other = self.units.get(row["id"])
            if other is not None and len(other) == len(fact["unit"]):
                scored.append((float(other @ fact["unit"]), row))
        return sorted((x for x in scored if x[0] >= floor), key=lambda x: (-x[0], -x[1]["importance"], -x[1]["confidence"], x[1]["id"]))[:most]

    def candidates(self, fact: dict) -> dict[str, dict]:
        """What a judge is shown: by meaning, by words, by entities; each row once."""
        terms, wanted = lexical.query_keywords(fact["content"]), fact["names"]
        by_meaning = (row for _, row in self.alike(fact, NEAR, self.thresholds.related))
        by_words = (r for r in chain(self._held(fact["lexical"]), self._new()) if terms and hits(terms, r["content"]) >= min(2, len(terms)))
        by_names = islice(chain((r for r in self._new() if r["names"] & wanted), self._held(fact["named"])), BY_NAME)
        found: dict[str, dict] = {}
        for row in chain(by_meaning, by_words, by_names):
            found.setdefault(row["id"], row)
        return dict(islice(found.items(), CANDIDATES))

    def contradicted(self, fact: dict) -> list[str]:
        """Active facts that give a single-valued statement of this one another value."""
        found: dict[str, None] = {}
        for subject, predicate, value in fact["claims"]:
            for told in fact["said"] or ():
                if (told["subject"], told["predicate"]) == (subject, predicate) and normalized(told["object"]) != value:
                    found.update((row["id"], None) for row in self._held([told["row"]]))
            found.update((row["id"], None) for row in self._new() for s, p, v in row["claims"] if (s, p) == (subject, predicate) and v != value)
        return list(found)

    # -- deciding -----------------------------------------------------------------
    def decide(self, fact: dict) -> Told:
        if (known := self.same_words(fact)) is not None:
            return self.enriched(known, fact, SAME_WORDS)
        best = next(iter(self.alike(fact, 1, -1.0)), None)
        if best and best[0] >= self.thresholds.duplicate:
            return self.enriched(best[1], fact, SAME_MEANING)
        shown, ruling, note = {}, None, ""
        if self.judge is not None and (shown := self.candidates(fact)):
            try:
                ruling = self.judge.judge(fact["content"], list(shown.values()))
            except Exception as fault:  # an outage blocks and destroys nothing
                note = NO_JUDGE.format(type(fault).__name__)
        if ruling is None:
            return self.stored(fact, fact["content"], self.outdated(fact, best), note)
        if same := next((i for i in ruling.same if i in shown), None):
            return self.enriched(shown[same], fact, SAME_JUDGED)
        return self.ruled(fact, ruling, shown)

    def ruled(self, fact: dict, ruling: Ruling, shown: dict[str, dict]) -> Told:
        old = dict.fromkeys([*(i for i in ruling.replaces if i in shown), *self.contradicted(fact)])
        line = usable_line(ruling.line) if old and self.keep_history else None
        return self.stored(fact, line or fact["content"], list(old), "")

    def outdated(self, fact: dict, best: tuple[float, dict] | None) -> list[str]:
        """Unjudged, a fact replaces one other at most, and only on strong evidence: another value of a single-valued
        statement, or the same state of a shared entity in nearly the same words."""
        if told := self.contradicted(fact):
            return told[:1]
        if best is None or best[0] < self.thresholds.supersede or fact["subtype"] not in STATE_SUBTYPES:
            return []
        near = best[1]
        return [near["id"]] if near["subtype"] == fact["subtype"] and fact["names"] & set(near["names"] or ()) else []

    # -- changing -----------------------------------------------------------------
    def enriched(self, row: dict, fact: dict, reason: str) -> Told:
        better = {c: fact[c] for c in ("confidence", "importance") if fact[c] > row[c]}
        if fact["event_time"] and not row["event_time"]:
            better["event_time"] = fact["event_time"]
        if better:
            row.update(better)
            self.touched[row["id"]] = None
        return Told("updated" if better else "ignored", reason, row["id"])

    def stored(self, fact: dict, content: str, old: list[str], note: str) -> Told:
        key = normalized(content)
        own = "mem_" + md5(f"{key}|{self.at}|{fact['place']}".encode()).hexdigest()
        kept = ("memory_type", "subtype", "confidence", "importance", "event_time", "source", "claims", "names")
        vector = fact["vector"] if content == fact["content"] else self.embed(content)
        self.rows[own] = {c: fact[c] for c in kept} | {"id": own, "content": content, "key": key, "status": "active", "superseded_by": None, "vector": vector}
        if vector is not None:
            self.units[own] = unit(vector)
        self.fresh.append(own)
        for i in old:
            self.rows[i].update(status="superseded", superseded_by=own)
            self.touched[i] = None
        return Told("superseded" if old else "created", (REPLACING if old else NEW) + note, own, tuple(old))


def unit(vector: list[float]) -> np.ndarray:
    found = np.asarray(vector, np.float64)
    return found / np.sqrt(found @ found)


def prepared(fact: dict[str, Any]) -> dict[str, Any]:
    """A fact with its normal names and single-valued statements."""
    names = {normalized(e["name"]) for e in fact["entities"] or ()}
    claims = [(normalized(r["subject"]), r["predicate"], normalized(r["object"])) for r in fact["relationships"] or () if single_valued(r["predicate"])]
    return fact | {"names": names, "claims": claims, "unit": None if fact["vector"] is None else unit(fact["vector"])}

"""Schema evidence, HTML, units, snapshots in file order: what stands between an export and a table."""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import SequenceMatcher
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units as (name, pattern of the unit, factor to the canonical unit).
UNITS = (("gram", "kg", 1000.0), ("gram", "g", 1.0), ("gram", "lb", 453.592), ("gram", "oz", 28.3495), ("ml", "ml", 1.0), ("ml", "l", 1000.0), ("mm", "mm", 1.0), ("mm", "cm", 10.0), ("mm", "inch", 25.4))


def best_unit(text: Column | str, kind: str, plausible: tuple[float, float] | None = None) -> Column:
    """The largest amount of a kind that a text states, in the canonical unit, between the ``plausible`` bounds; null if none."""
    text = F.col(text) if isinstance(text, str) else text

    def amounts(unit: str, factor: float) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"(\d+(?:\.\d+)?)\s*{unit}\b"), 1), lambda x: x.cast("double") * factor)

    stated = F.concat(*[amounts(unit, factor) for name, unit, factor in UNITS if name == kind])
    return F.array_max(F.filter(stated, lambda x: x.between(*plausible)) if plausible else stated)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one assignment of rows to columns (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], at = row, 0
        least, used, before = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[at]:
            used[at] = True
            own = cost[match[at] - 1] - u[match[at]] - v[1:]
            better = ~used[1:] & (own < least[1:])
            least[1:][better], before[1:][better] = own[better], at
            free = np.where(used[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            step = free[nxt - 1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            at = nxt
        while at:
            match[at] = match[before[at]]
            at = before[at]
    return sorted((int(match[c]) - 1, c - 1) for c in range(1, m + 1) if match[c])


@dataclass(frozen=True)
class Name:
    """A header or synonym as its words: lower case, without a unit in brackets, all but letters and digits as blanks."""

    words: tuple[str, ...]

    @classmethod
    def of(cls, text: str) -> Name:
        return cls(tuple(re.findall(r"[^\W_]+", _BRACKETS.sub(" ", str(text).lower()))))

    @property
    def text(self) -> str:
        return " ".join(self.words)

    def has_words(self, other: Name) -> bool:
        return bool(other.words) and set(other.words) <= set(self.words)

    def holds(self, other: Name) -> bool:
        """Scripts without blanks: the other stands somewhere inside."""
        return len(other.text) > 1 and not other.text.isascii() and other.text in self.text

    def close_to(self, other: Name) -> bool:
        return bool(self.words and other.words) and SequenceMatcher(None, self.text, other.text).ratio() >= CLOSE_RATIO


_BRACKETS = re.compile(r"\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]")
CLOSE_RATIO = 0.85
#: How well a header names a field by a synonym of it; the first rule that holds counts.
NAMING = (
    (1.0, lambda header, synonym: header == synonym and bool(header.words)),
    (0.8, lambda header, synonym: header.has_words(synonym) and len(set(synonym.words)) > 1),
    (0.7, lambda header, synonym: header.has_words(synonym)),
    (0.75, Name.holds),
    (0.6, Name.close_to),
)


def field_score(header: str, synonyms: list[str]) -> float:
    """How well a header names a field: the best that ``NAMING`` gives over its synonyms, 0 without any."""
    own = Name.of(header)
    return max((next((value for value, rule in NAMING if rule(own, s)), 0.0) for s in map(Name.of, synonyms)), default=0.0)


def header_scores(df: DataFrame, header: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """(header, field, score) of every distinct header of a column for every field."""

    def score(batches):
        for b in batches:
            rows = [(h, f, field_score(h, own)) for h in b[header] for f, own in synonyms.items()]
            yield pd.DataFrame(rows, columns=["header", "field", "score"])

    return df.select(header).where(F.col(header).isNotNull()).distinct().mapInPandas(score, "header string, field string, score double")


def greedy_headers(headers: list[str], synonyms: dict[str, list[str]], least: float = 0.6) -> dict[str, str]:
    """field -> header, the best score first (ties: later names); each field and header is used once."""
    found: dict[str, str] = {}
    for score, field, header in sorted(((field_score(h, own), f, h) for f, own in synonyms.items() for h in headers), reverse=True):
        if score >= least and field not in found and header not in found.values():
            found[field] = header
    return found


def map_headers(headers: list[str], aliases: dict[str, list[str]], least: float = 0.6, pinned: dict[str, str] | None = None, parent: dict[str, list[str]] | None = None) -> dict[str, str]:
    """field -> header, one to one and best in total; pinned fields are taken as given. A header that names a field of the variation
    family (``parent``: its synonyms for a field) better than the field itself counts half for it."""
    pinned = pinned or {}
    fields, free = [f for f in aliases if f not in pinned], [h for h in headers if h not in pinned.values()]
    if not fields or not free:
        return dict(pinned)

    def score_of(field: str, header: str) -> float:
        own = field_score(header, [field, *aliases[field]])
        return own / 2 if field_score(header, (parent or {}).get(field, [])) >= max(own, least) else own

    score = np.array([[score_of(f, h) for h in free] for f in fields])
    wide = np.hstack([score, np.zeros((len(fields), len(fields)))])  # a field may stay unmapped
    return pinned | {fields[i]: free[j] for i, j in assign(-wide) if j < len(free) and score[i, j] >= least}


def header_row(df: DataFrame, required: dict[str, list[str]], rows: int = 8) -> int | None:
    """The first of the leading rows whose cells name every required field."""
    for k, r in enumerate(df.limit(rows).collect()):
        if len(map_headers([str(x) for x in r if x is not None], required)) == len(required):
            return k
    return None


def snapshot_order(df: DataFrame, path: str) -> DataFrame:
    """(file, day, place): files by the date in their name, then by name."""
    name = F.regexp_extract(F.col(path), r"([^/]+)$", 1)
    day = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(name, r"(\d{4}[-_]?\d{2}[-_]?\d{2})", 1), "[-_]", ""), F.lit("yyyyMMdd")).cast("date")
    from pyspark.sql import Window as W

    return df.select(name.alias("file"), day.alias("day")).withColumn("place", F.row_number().over(W.orderBy(F.col("day").asc_nulls_last(), "file")))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.text, self.open = "", 0, [], []

    def handle_starttag(self, tag, attrs):
        self.links += tag == "a"
        if tag in ("title", "script", "style"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if self.open and self.open[-1] == tag:
            self.open.pop()

    def handle_data(self, data):
        if not self.open:
            self.text.append(data)
        elif self.open[-1] == "title":
            self.title += data


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, links, text of each page; null html gives empty values."""

    def run(batches):
        for b in batches:
            out = []
            for html in b["html"]:
                p = _Page()
                p.feed(html or "")
                p.close()
                out.append((" ".join(p.title.split()), p.links, " ".join(" ".join(p.text).split())))
            yield pd.DataFrame({"page_id": b["page_id"], "title": [x[0] for x in out], "links": [x[1] for x in out], "text": [x[2] for x in out]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, links long, text string")


#: Words that make the number after them a limit, words that make the number before them a rating, words without meaning, by default.
LIMITS = {"max_price": ("under", "below", "within", "less", "most", "max", "maximum"), "min_price": ("over", "above", "beyond", "more", "least", "min", "minimum")}
RATINGS, BETWEEN = ("star", "stars", "rated"), ("to", "and", "-")
FILLERS = frozenset("a an the for with and or of in i to than want need".split())


def _tokens(text: str) -> list[str | float]:
    """Words and numbers of a text in order; a hyphen counts only between numbers."""
    out: list[str | float] = []
    word = ""
    for c in f"{text.lower()} ":
        if c.isalnum() or c == "." and word.isdigit():
            word += c
            continue
        if word:
            out.append(float(word.rstrip(".")) if word[0].isdigit() and word.replace(".", "", 1).isdigit() else word.rstrip("."))
            word = ""
        if c == "-":
            out.append(c)
    return out


def parse_request(text: str, limits: dict[str, tuple[str, ...]] = LIMITS, ratings: tuple[str, ...] = RATINGS, fillers: frozenset[str] = FILLERS) -> dict:
    """Price limits, a range, a least rating and the words that are left of a request, by its tokens from left to right.

    A number before a rating word is a least rating. Two numbers around a word or mark of range are the two limits. A number after
    a limit word is that limit. Of two that say the same the first counts. Other words are keywords, but for fillers."""
    tokens, out, used = _tokens(text), {}, set()
    number = lambda i: 0 <= i < len(tokens) and isinstance(tokens[i], float) and i not in used

    def take(name: str, at: int, *marks: int) -> None:
        out.setdefault(name, tokens[at])
        used.update((at, *marks))

    for i, token in enumerate(tokens):
        if token in ratings and number(i - 1):
            take("min_rating", i - 1, i)
    for i, token in enumerate(tokens):
        if token in BETWEEN and number(i - 1) and number(i + 1):
            take("min_price", i - 1, i)
            take("max_price", i + 1)
    for i, token in enumerate(tokens):
        for name, words in limits.items():
            if token in words:
                at = next((k for k in range(i + 1, min(i + 3, len(tokens))) if number(k)), None)
                if at is not None:
                    take(name, at, i)
    return out | {"keywords": [t for i, t in enumerate(tokens) if i not in used and isinstance(t, str) and t != "-" and t not in fillers and not any(c.isdigit() for c in t)]}

"""Fuzzy search for short licence notices.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters, joined by single blanks. A notice
of length m may differ from a phrase in up to `errors` characters (inserted, deleted or replaced). Split into
errors + 1 pieces, at least one piece stands unchanged (pigeonhole): an Aho-Corasick automaton of all pieces
finds candidates, and the regex library's bounded-error matching verifies the window around each and reports
its span. The words that tell a notice from its look-alikes (names, `nc`, versions) must stand unchanged among the words
of the span. Exact occurrences at word boundaries (the base) are found apart and always kept.

Defined results: null, empty and wordless texts have no words and no labels; very long texts are scanned whole; each of
equal rows is scanned alone; ties between notices are all reported; an empty table gives no rows; extra columns pass
through, and columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose exact occurrences count, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices looked for with errors, and their labels.
NOTICES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "apache license version 1 1": "apache-1",
    "apache license version 1 0": "apache-1",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution no derivatives": "cc-by-nd",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "mozilla public license version 1 1": "mpl-1",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "dedicated to the public domain": "public-domain",
}
# The words that tell a notice from others like it. They must stand as they are, in order; errors lie elsewhere.
TELLING = ("mit", "apache", "cc", "nc", "sa", "nd", "non", "commercial", "share", "derivatives", "gnu", "general", "lesser", "affero", "mozilla", "domain", "0", "1", "2", "4")
#: Errors allowed: one in so many characters, four at most.
CHARS_PER_ERROR, MAX_ERRORS = 10, 4
STOPS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(32 if (c | 32 if 65 <= c <= 90 else c) in STOPS else (c | 32 if 65 <= c <= 90 else c) for c in range(256))


def normalise(text: str | None) -> bytes:
    """Lower-cased words, each with a blank before and after it, as UTF-8."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b""


class Finder:
    def __init__(self, notices=NOTICES, base=BASE, chars_per_error: int = CHARS_PER_ERROR, max_errors: int = MAX_ERRORS, telling=TELLING):
        import ahocorasick
        import regex

        self.base = [(f" {p} ".encode(), label) for p, label in sorted(base.items())]
        self.auto, self.notices = ahocorasick.Automaton(), []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (p, label) in enumerate(sorted(notices.items())):
            e = min(max_errors, len(p) // chars_per_error)
            self.notices.append((p, label, e, regex.compile(rf"(?e)(?:{regex.escape(p, literal_spaces=True)}){{e<={e}}}")))
            cuts = [len(p) * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(p[a:b], []).append((k, a))
        for s, at in seeds.items():
            self.auto.add_word(s, (len(s), at))
        self.auto.make_automaton()
        self.exact = [[w for w in p.split() if w in telling] for p, *_ in self.notices]

    def agrees(self, k: int, text: str, start: int, end: int) -> bool:
        """Whether the words that a span touches hold the notice's telling words, in order."""
        words = iter(text[max(0, text.rfind(" ", 0, start + 1)) : text.find(" ", end - 1) % (len(text) + 1)].split())
        return all(w in words for w in self.exact[k])

    def base_starts(self, joined: bytes) -> list[tuple[int, str]]:
        """(word index, label) of every place where a base phrase stands."""
        out = []
        for p, label in self.base:
            at = joined.find(p)
            while at >= 0:
                out.append((joined.count(b" ", 0, at), label))
                at = joined.find(p, at + 1)
        return sorted(out)

    def fuzzy(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, errors) in characters of the joined text: of each notice, from the left, without overlaps, each
        drawn to its nearest best fit."""
        windows: dict[int, list[list[int]]] = {}
        for end, (n, at) in self.auto.iter(text):
            for k, a in at:
                p, _, e, _ = self.notices[k]
                lo = max(0, end - n + 1 - a - e)
                hi = min(len(text), lo + len(p) + 3 * e + 1)
                mine = windows.setdefault(k, [])
                if mine and lo <= mine[-1][1]:
                    mine[-1] = [min(lo, mine[-1][0]), max(hi, mine[-1][1])]
                else:
                    mine.append([lo, hi])
        out = []
        for k, spans in windows.items():
            _, label, _, rx = self.notices[k]
            for lo, hi in spans:
                out += [(m.start(), m.end(), label, sum(m.fuzzy_counts)) for m in rx.finditer(text, lo, hi) if self.agrees(k, text, m.start(), m.end())]
        return sorted(out)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<start_word:long,end_word:long,label:string,errors:int>>"


def scan_licenses(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """df with the columns of SCHEMA; notices holds the spans found with errors, in words (end exclusive)."""
    from skein.llm.common import add_columns

    return add_columns(df, text, SCHEMA, lambda: (lambda t, find=Finder(**options): _row(find, t)))


def _row(find: Finder, text: str | None) -> tuple:
    joined = normalise(text)
    base = find.base_starts(joined)
    text = joined.decode("utf-8", "replace")
    found = find.fuzzy(text)
    spans = [{"start_word": text.count(" ", 0, s + (text[s] == " ")) - 1, "end_word": text.count(" ", 0, e - (text[e - 1] == " ")), "label": label, "errors": n} for s, e, label, n in found]
    base_labels = sorted({x for _, x in base})
    labels = sorted({*base_labels, *(x[2] for x in found)})
    score = 1.0 if base else max((1.0 - x[3] / max(1, x[1] - x[0]) for x in found), default=0.0)
    return joined.count(b" ") - 1 if joined else 0, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(base_labels), ",".join(labels), score, spans


def op4(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import table

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("notices").cast("long").alias("n_notices"))

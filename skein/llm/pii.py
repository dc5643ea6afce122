"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the whole text: at-signs, plus signs, digits, scheme
separators and identifier cues. Around each, a deterministic local parser expands to the boundaries of the
e-mail, address, card, phone number, account value or user-info of a URL, and validates it. Within a kind the
spans are leftmost and do not overlap; a match that fails validation is consumed and not retried.

Kinds, in order: email, ip, card, phone (the base), then account and login (user:password@ after ://). An account is an
IBAN behind its cue, in groups or not (without a mark between its check digits must hold), or a value of 8 characters or more with a digit behind a cue. Cues are
looked for in any case of ASCII letters; words such as `access`, `key` or `number` may follow one, joined by blanks, hyphens
or underscores, before `:`, `=`, `#` or `is`, which may be missing behind `number`, `no.` and the like. Spans are in code points, end
exclusive. Defined results: null and empty texts have no spans; very long texts are scanned whole; equal rows are scanned
alone; an empty table gives no rows; extra columns pass through, and columns named like an output are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "account", "login")
# Cues that stand before an account or a secret, in lower case; a blank stands for a blank, a hyphen, an underscore or nothing.
CUES = (
    "token", "account", "acct", "iban", "bic", "password", "passwd", "passcode", "passphrase", "pass phrase", "pwd", "api key", "access key", "private key", "secret", "credential", "bearer", "auth key",
    "ssn", "social security", "passport", "national id", "tax id", "tax number", "routing", "sort code", "customer id", "user id", "client id", "member id", "employee id", "patient id", "session id",
    "driver license", "drivers license", "driver licence", "drivers licence", "license key", "licence key", "policy number", "insurance number", "serial number",
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IP_RUN, _CARD_RUN = re.compile(r"[0-9.]+"), re.compile(r"[0-9\x20-]+")
_WORD = r"(?:access|secret|private|public|api|auth|client|service|bank|account|licen[sc]e|security)"
_NOUN = r"(?:numbers?|num\b\.?|no\b\.?|nr\b\.?|keys?|id|code|token|value)"
_ACCOUNT = re.compile(
    rf"""(?:[\x20\t_-]?{_WORD}\b|[_-]{_WORD})*(?:(?P<noun>[\x20\t_-]?{_NOUN})?["']?[\x20\t]*(?P<mark>[:=#]|is\b)?)[\x20\t]*["']?(?P<value>[A-Za-z0-9_/+-]{{8,}})""", re.I | re.A
)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_AFTER_IBAN = re.compile(r"""[\x20\t]*(?:number|no\.?|code)?[\x20\t]*(?P<mark>[:=#]|is\b)?[\x20\t]*["']?""", re.I)
_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s@/:]+(?=@[A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban(value: str) -> bool:
    """Whether the check digits hold."""
    x = value.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


class Finder:
    def __init__(self, cues=CUES):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for ch in "@+0123456789":
            self.auto.add_word(ch, ch)
        self.auto.add_word("://", "://")
        for cue in cues:
            for join in (" ", "-", "_", ""):
                self.auto.add_word(cue.replace(" ", join), "iban" if cue == "iban" else "cue")
        self.auto.make_automaton()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end), by kind and then start."""
        if not text:
            return []
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        past = dict.fromkeys(KINDS, 0)  # each kind's end of what is consumed
        run = {"ip": 0, "card": 0}
        low = text.translate(_UP) if text.isascii() is False else text.lower()
        for end, what in self.auto.iter(low):
            if what == "@":
                self._email(text, end, found, past)
            elif what == "+":
                m = _PHONE.match(text, end)
                if m and 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
            elif what in ("cue", "iban"):
                self._account(text, end + 1, what, found, past)
            elif what == "://":
                if m := _LOGIN.match(text, end + 1):
                    found["login"].append(m.span())
            else:
                if end >= run["ip"]:
                    run["ip"] = self._digits(text, end, _IP_RUN, _IP, found["ip"], lambda s: all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in s.split(".")))
                if end >= run["card"]:
                    run["card"] = self._digits(text, end, _CARD_RUN, _CARD, found["card"], self._card)
        return [(k, a, b) for k in KINDS for a, b in found[k]]

    @staticmethod
    def _account(text, at, what, found, past) -> None:
        if at < past["account"]:
            return
        if what == "iban" and (m := _IBAN.match(text, (to := _AFTER_IBAN.match(text, at)).end())) and (to["mark"] or iban(m[0])):
            span = m.span()
        elif (m := _ACCOUNT.match(text, at)) and (m["mark"] or m["noun"]) and any("0" <= c <= "9" for c in m["value"]):
            span = m.span("value")
            if not m["mark"] and not ("0" <= m["value"][0] <= "9"):
                return  # behind a bare noun only what begins with a digit
        else:
            return
        found["account"].append(span)
        past["account"] = span[1]

    @staticmethod
    def _card(s: str) -> bool:
        digits = s.replace(" ", "").replace("-", "")
        return 16 <= len(digits) <= 19 and luhn(digits)

    @staticmethod
    def _digits(text, at, around, pattern, out, good) -> int:
        """Matches in the run of allowed characters that begins at this digit; returns the run's end.

        What stands before the first digit of a run (dots, blanks, hyphens) can begin no match."""
        stop = around.match(text, at).end()
        out += [m.span() for m in pattern.finditer(text, at, stop) if good(m[0])]
        return stop

    @staticmethod
    def _email(text, at, found, past) -> None:
        start = at
        while start > past["email"] and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found["email"].append((start, m.end()))
            past["email"] = m.end()


def redact(text: str | None, spans) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its first kind, such as [EMAIL]."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "pii array<struct<kind:string,start:long,end:long>>"


def find_pii(df: DataFrame, text: str = "text", cues=CUES) -> DataFrame:
    """df with column pii: every span, by kind and start."""
    from skein.llm.common import add_columns

    def maker():
        find = Finder(cues)
        return lambda t: ([{"kind": k, "start": a, "end": b} for k, a, b in find.spans(t)],)

    return add_columns(df, text, SCHEMA, maker)


def redact_pii(df: DataFrame, text: str = "text", cues=CUES) -> DataFrame:
    """df with every span of its text replaced by the kind."""
    from skein.llm.common import add_columns

    def maker():
        find = Finder(cues)
        return lambda t: (redact(t, find.spans(t)),)

    order = df.columns
    return add_columns(df, text, f"`{text}` string", maker).select(*order)


def op9(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import table

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    n = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS[:4]))
    return found.select("doc_id", *map(n, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), (F.size("pii") > 0).alias("has_pii"))

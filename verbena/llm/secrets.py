"""Secret scans: fixed patterns, and guess-cost scoring of values that stand in a credential context."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import small_batches

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What makes the rest of a line's next token a credential's value.
_CONTEXT = re.compile(r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth|bearer|private[_-]?key)["']?[\x20\t]*([:=]|=>|\bis\b)?[\x20\t]*(["']?)([^\s"',;<>|]{6,})""", re.ASCII)
#: A cheap test for texts that hold neither kind of context.
_ANY = re.compile(r"pass|pwd|secret|token|api|cred|auth|bearer|private|AKIA|[0-9a-f]{24}", re.IGNORECASE | re.ASCII)
#: log10 of the guesses from which a value is taken for a machine-made secret.
THRESHOLD = 11.0
#: More for a value without digits after a blank or a bare "is", where prose stands, and of which each part counts alone.
BARE_MORE = 19.0
_PARTS = re.compile(r"[A-Za-z0-9!@#$%^&*+~?]+")
#: The longest word that opens a context.
_OPENS = 11

# Common words of passwords and placeholders by rank, keyboard rows.
_WORDS = "password secret token admin user login welcome changeme example test default letmein qwerty dragon master monkey shadow love hello sunshine princess football baseball superman batman summer winter spring autumn company server database public private access account system your here none null true false value string enter this that the and for with not".split()
# longer words of prose, after those
_WORDS += "required optional changed expired invalid incorrect missing unknown disabled enabled protected encrypted provided generated username authentication authorization authorized unauthorized credentials permission permissions security management manager service services application applications information configuration settings environment variable variables development production documentation description available important different following additional administrator successful successfully sensitive confidential something anything everything nothing whatever somewhere someone everyone undefined redacted placeholder sample customer international government university american national community education business research technology experience including according together children question problem president position condition operation relation function structure standard material personal economic political industry increase activity building religion decision direction discussion situation interest organization association communication transaction validation verification certificate identity identifier reference response request requirements resource repository container kubernetes connection interface procedure process processing program programming language character characters sentence paragraph document documents message messages passwords passphrase passcode bearer authority author authors ingredient ingredients recovery rotation rotated revoked accepted rejected forgotten remember recommended temporary permanent minimum maximum uppercase lowercase alphanumeric special combination beginning understand understanding themselves themself yourself ourselves another through without between because although however therefore usually probably certainly especially actually generally possible impossible necessary difference knowledge literature history medicine mountain yesterday tomorrow afternoon breakfast christmas september november december february wednesday thursday saturday".split()
_RANK = {w: i + 1 for i, w in enumerate(_WORDS)}
_LONGEST = 16
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEXT = {}
for _r, _row in enumerate(_ROWS):
    for _i, _c in enumerate(_row):
        near = set(_row[max(0, _i - 1) : _i + 2])
        for _o in (_r - 1, _r + 1):
            if 0 <= _o < len(_ROWS):
                near |= set(_ROWS[_o][max(0, _i - 1) : _i + 2])
        _NEXT[_c] = near - {_c}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_LEET = str.maketrans("@4301!5$7", "aaeoilsst")


def word_ranks(path: str | None = None) -> dict[str, int]:
    """Ranks of words: the common ones of passwords first, then the whole words of a tokenizer's vocabulary (a file of the
    tokenizers library, of a kind that marks word ends), whose order is that of their frequency in its training texts."""
    if path is None:
        return _RANK
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    end = model.get("end_of_word_suffix") or ""
    known = sorted((i, t.removesuffix(end)) for t, i in model["vocab"].items() if t.endswith(end))
    words = [w for _, w in known if 3 <= len(w) <= _LONGEST and w.isalpha() and w.islower()]
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*_WORDS, *words]))}


def _alphabet(s: str) -> int:
    return max(10, 10 * bool(re.search(r"\d", s)) + 26 * bool(re.search("[a-z]", s)) + 26 * bool(re.search("[A-Z]", s)) + 33 * bool(re.search("[^A-Za-z0-9]", s)))


def guesses(value: str, enough: float = math.inf, ranks: dict[str, int] = _RANK) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses of the cheapest segmentation, and the segments (kind, start, end).

    best[j] is the least cost of the first j characters: a segment i..j is a word (its rank; more for capitals and
    look-alike digits), a date (days of 130 years), a repeat of a unit (the unit's cost times the count), a keyboard walk
    (keys * turns) or brute force (alphabet ** length). Each further segment costs a factor of 2, so that cheap
    pieces aren't free to combine. An empty value costs 0. Once no segmentation can cost less than ``enough``, the least
    cost so far is returned, for the part looked at. Repeats and walks start only near the beginning of a run: later in
    it the one that goes on is cheaper. So the time is linear in the length.
    """
    s = value
    low = s.lower()
    leet = low.translate(_LEET)
    n, size = len(s), math.log10(_alphabet(s))
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    ahead: dict[int, tuple[float, int, str]] = {}
    same, keys, steps = [0] * 9, 0, 0  # how far back the runs at i go: of each unit, of neighbouring keys, of characters in sequence

    def put(j: int, cost: float, kind: str) -> None:
        new = (best[i][0] + cost + 0.3 * (i > 0), i, kind)
        if j not in ahead or new < ahead[j]:
            ahead[j] = new

    for i in range(n):
        if i:
            # a brute-force span that goes on with one costs no further segment
            brute = (best[i - 1][0] + size + 0.3 * (best[i - 1][2] not in ("", "brute")), i - 1, "brute")
            best.append(min(ahead.pop(i, brute), brute))
            if i % 16 == 0 and best[i][0] >= enough and min((x[0] for x in ahead.values()), default=enough) >= enough:
                n = i
                break
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            for form, extra in ((low, 0.0), (leet, 0.6)):
                if rank := ranks.get(form[i:j]):
                    put(j, math.log10(rank + 1) + extra + 0.3 * (s[i:j] != low[i:j]), "word")
        if m := _DATE.match(s, i):
            put(m.end(), math.log10(130 * 365 if m.end() - i > 4 else 130), "date")
        keys = keys + 1 if i and low[i] in _NEXT.get(low[i - 1], ()) else 0
        if keys <= _LONGEST:
            j, turns = i + 1, 0
            while j < n and low[j] in _NEXT.get(low[j - 1], ()):
                turns += j > i + 1 and ord(low[j]) - ord(low[j - 1]) != ord(low[j - 1]) - ord(low[j - 2])
                j += 1
                if j - i >= 4:
                    put(j, math.log10(47 * (j - i)) + 0.3 * turns, "walk")
        steps = steps + 1 if i and abs(ord(s[i]) - ord(s[i - 1])) == 1 and (i < 2 or steps == 0 or ord(s[i]) - ord(s[i - 1]) == ord(s[i - 1]) - ord(s[i - 2])) else 0
        if steps <= _LONGEST:
            j = i + 1
            while j < n and abs(ord(s[j]) - ord(s[j - 1])) == 1 and (j < i + 2 or ord(s[j]) - ord(s[j - 1]) == ord(s[i + 1]) - ord(s[i])):
                j += 1
                if j - i >= 4:
                    put(j, math.log10(40 * (j - i)), "walk")
        for unit in range(1, min(8, (n - i) // 2) + 1):
            same[unit] = same[unit] + 1 if i and s[i - 1] == s[i - 1 + unit] else 0
            if same[unit] > unit + _LONGEST:
                continue
            j = i + unit
            while j + unit <= n and s[j : j + unit] == s[i : i + unit]:
                j += unit
            if (j - i) // unit >= (3 if unit == 1 else 2):
                put(j, unit * size + math.log10((j - i) // unit), "repeat")
    else:
        if n:
            brute = (best[n - 1][0] + size + 0.3 * (best[n - 1][2] not in ("", "brute")), n - 1, "brute")
            best.append(min(ahead.pop(n, brute), brute))
    segments, j = [], n
    while j:
        i, kind = best[j][1:]
        if kind == "brute" and segments and segments[-1][0] == "brute":
            segments[-1] = (kind, i, segments[-1][2])
        else:
            segments.append((kind, i, j))
        j = i
    return best[n][0], segments[::-1]


def _secret(value: str, explicit: bool, threshold: float, ranks: dict[str, int]) -> bool:
    if explicit or re.search(r"\d", value):
        return guesses(value, threshold, ranks)[0] >= threshold
    more = threshold + BARE_MORE
    return any(guesses(part, more, ranks)[0] >= more for part in _PARTS.findall(value) if len(part) >= 6)


def scan(text: str, threshold: float = THRESHOLD, ranks: dict[str, int] = _RANK) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind as listed, then end."""
    if not _ANY.search(text):
        return []
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    at = 0
    while m := _CONTEXT.search(text, at):
        value = m[3].rstrip(".)]}!?:&*#$%")
        explicit = bool(m[2]) or (m[1] or "is").lower() != "is"
        at = m.end()
        if len(value) >= 6 and _secret(value, explicit, threshold, ranks):
            out.append(("guess", m.start(3), m.start(3) + len(value)))
        elif not explicit and (inner := re.search("[:=]", m[3])):
            # prose may hold an explicit context
            at = max(m.start(3), m.start(3) + inner.start() - _OPENS)
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan_all(threshold: float, ranks):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [scan(t, threshold, ranks.value) for t in b["text"]]
            base = [[x for x in f if x[0] != "guess"] for f in found]
            out = pd.DataFrame({"id": b["id"]})
            for kind in KINDS[:3]:
                out[f"n_{kind}"] = [sum(x[0] == kind for x in f) for f in base]
            out["base_sha256"] = [hashlib.sha256(written(f).encode()).hexdigest() for f in base]
            out["spans"] = [written(f) for f in found]
            out["n_guess"] = [sum(x[0] == "guess" for x in f) for f in found]
            yield out

    return run


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: str | None = None) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_guess. No shuffle.

    words: the path, on the driver, of the vocabulary that `word_ranks` takes (some ten thousand words, broadcast); without it
    a short list serves. Null and empty texts have no spans; null and repeated ids pass through; an empty table gives an
    empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = rows.mapInPandas(_scan_all(threshold, docs.sparkSession.sparkContext.broadcast(word_ranks(words))), "id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
    return got.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)

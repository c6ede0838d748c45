"""Secret scans: an Aho-Corasick pass over the keywords of all rules, anchored regular expressions at the hits, checksums.

A rule has keywords, a regular expression that is tried only at fixed places around a keyword's hit, and a validator
for what the format itself can prove: CRC-32 of access tokens, the mod-97 sum of account numbers, the decoded header of
web tokens, the entropy of free-form values.  A candidate that its validator refuses is no secret.

Assigned values have any length from 8 characters, and letters alone are none.  Quoted ones may hold blanks and end with their line
at the latest; those without quotes end at a blank, a quote, an angle bracket or the next assignment; names, calls
and plain addresses in their place are no secrets.  What redaction writes, the name of a rule in angle brackets, is none either.  A
private key goes to its END line or, where it is cut off before the next BEGIN, over the header and base64 lines that follow.  No
expression looks back from a keyword or reads on past the next one, so texts full of keywords take time in proportion to their length.

Defined cases: null and empty texts have no findings; null ids are carried along; texts are scanned whole; of
findings that overlap the one that starts first (then the longest, then one of a format of its own) counts; rows that repeat are scanned each; an
empty table gives an empty one; other columns are kept by `redact_secrets`, which sets n_chars, if there is one, for changed
texts only.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import ship

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str, check: str) -> bool:
    """Whether check is the CRC-32 of body in base 62, padded to six digits."""
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = _BASE62[d] + digits
    return digits.rjust(6, "0") == check


def iban_valid(text: str) -> bool:
    s = re.sub(r"[ \-]", "", text).upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def luhn_valid(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return len(set(digits)) > 1 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def web_token_valid(text: str) -> bool:
    head = text.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _free_value(text: str) -> bool:
    """Neither words nor the mark of a redaction."""
    return entropy(text) >= 3.0 and not re.fullmatch(r"[A-Za-z ]+", text) and text not in _MARKS


def _unquoted_value(text: str) -> bool:
    """A free value that is neither a name, a call or an index in code nor an address without user or query."""
    return _free_value(text) and not re.fullmatch(r"\$?[A-Za-z_]+(?:\.[A-Za-z_]+)*|\$\{?\w+|[A-Za-z_][\w.]*[(\[{].*|\w+://[^@?]*", text)


#: The name, from its keyword on, and the sign of an assignment.
_ASSIGNED_WORDS = ("token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "auth_key", "private_key")
_NAME = r"(?i:token|secret|password|passwd|pwd|api[_\-]?key|access_key|auth_key|private_key)(?i:[a-z_]{0,8}+)"
_ASSIGNED = _NAME + r"[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}"
_QUOTED = r"(?:\"(?P<secret>[^\"\r\n]{8,})\"|'(?P<single>[^'\r\n]{8,})')"
_BARE = rf"(?P<bare>[^\s\"'<>=:(\[{{](?:(?!{_NAME}[:=])[^\s\"'<>]){{6,}}(?<![.,;:!?)\]}}]))"
_KEY_LINE = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_KEY_HEADERS = r"(?:[ \t]*\r?\n[ \t]*[A-Za-z][A-Za-z0-9\-]*:[^\r\n]*)*+"
_KEY_LINES = r"(?:(?:[ \t]*\r?\n)++[ \t]*[0-9A-Za-z+/=]+[ \t]*(?=\r?\n|\Z)|(?:\s|\\[rn])++[0-9A-Za-z+/=]{16,})*+"


@dataclass(frozen=True)
class Rule:
    """pattern is matched where a keyword is hit; its last group is the finding, which `bare` tests if the group is so called."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    valid: Callable[[str], bool] | None = None
    bare: Callable[[str], bool] | None = None

    def finding(self, text: str, match: re.Match | None) -> tuple[int, int, str] | None:
        if match:
            start, end = match.span(match.lastgroup)
            test = self.bare if match.lastgroup == "bare" else self.valid
            if test is None or test(text[start:end]):
                return start, end, self.name
        return None


RULES = (
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?P<secret>gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])", lambda s: crc_base62(s[4:-6], s[-6:])),
    Rule("npm_token", ("npm_",), r"(?P<secret>npm_[0-9A-Za-z]{36})(?![0-9A-Za-z])", lambda s: crc_base62(s[4:-6], s[-6:])),
    Rule("aws_key_id", ("akia", "asia"), r"(?P<secret>A[KS]IA[A-Z2-7]{16})(?![0-9A-Za-z])"),
    Rule("slack_token", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), r"(?P<secret>xox[abprs]-(?:[0-9]+-){1,4}[0-9A-Za-z]{16,})"),
    Rule("stripe_key", ("sk_live_", "rk_live_"), r"(?P<secret>[sr]k_live_[0-9A-Za-z]{16,})"),
    Rule("google_key", ("aiza",), r"(?P<secret>AIza[0-9A-Za-z_\-]{35})(?![0-9A-Za-z_\-])"),
    Rule("web_token", ("eyj",), r"(?<![0-9A-Za-z_\-])(?P<secret>eyJ[0-9A-Za-z_\-]{8,}+\.[0-9A-Za-z_\-]{8,}+\.[0-9A-Za-z_\-]{8,})", web_token_valid),
    Rule("private_key", ("-----begin",), rf"(?P<secret>-----BEGIN {_KEY_LINE}(?:(?s:(?:(?!-----BEGIN ).)*?)-----END {_KEY_LINE}|{_KEY_HEADERS}{_KEY_LINES}))"),
    Rule("iban", ("iban",), r"(?i:iban)[\s:=]{1,3}(?P<secret>[A-Z]{2}[0-9]{2}(?:[ \-]?[0-9A-Z]){11,30})(?![0-9A-Za-z])", iban_valid),
    Rule("payment_card", ("card", "visa", "mastercard"), r"(?i:card|visa)[A-Za-z ]{0,16}[\s:=#]{1,3}(?P<secret>[0-9](?:[ \-]?[0-9]){12,18})(?![0-9])", luhn_valid),
    Rule("assigned_secret", _ASSIGNED_WORDS, _ASSIGNED + f"(?:{_QUOTED}|{_BARE})", _free_value, _unquoted_value),
)
_MARKS = frozenset(f"<{r.name}>" for r in RULES)

Finding = tuple[int, int, str]


def fold_ascii(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def build_scanner(rules: tuple[Rule, ...] = RULES) -> Callable[[str], list[Finding]]:
    """A function from a text to its findings (start, end, rule) in order."""
    automaton = ahocorasick.Automaton()
    wanted: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for word in rule.keywords:
            wanted.setdefault(word, []).append(k)
    for word, ks in wanted.items():
        automaton.add_word(word, (len(word), tuple(ks)))
    automaton.make_automaton()
    compiled = [re.compile(r.pattern) for r in rules]

    def scan(text: str) -> list[Finding]:
        found: set[Finding] = set()
        for end, (length, ks) in automaton.iter(fold_ascii(text)):
            at = end - length + 1
            for k in ks:
                if f := rules[k].finding(text, compiled[k].match(text, at)):
                    found.add(f)
        return without_overlaps(found)

    return scan


def without_overlaps(found: set[Finding]) -> list[Finding]:
    out: list[Finding] = []
    for f in sorted(found, key=lambda f: (f[0], -f[1], f[2] == "assigned_secret", f[2])):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def brute_force(text: str, rules: tuple[Rule, ...] = RULES) -> list[Finding]:
    """The same findings from every rule's expression at every place, for tests."""
    found = set()
    for rule in rules:
        expression = re.compile(rule.pattern)
        for start in range(len(text)):
            if f := rule.finding(text, expression.match(text, start)):
                found.add(f)
    return without_overlaps(found)


_FINDINGS = pa.schema(
    [("doc_id", pa.int64()), ("rule", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("fingerprint", pa.string())]
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = build_scanner()
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = text.as_py()
            for start, end, rule in scan(s) if s else ():
                mark = hashlib.sha256(s[start:end].encode()).hexdigest()[:16]
                for column, v in zip(out, (doc_id, rule, start, end, mark)):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _FINDINGS.types)], schema=_FINDINGS)


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each secret: doc_id, rule, its characters [start, end) and a fingerprint, never the secret itself."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_find, "doc_id bigint, rule string, start_char int, end_char int, fingerprint string")


def redact(text: str, found: list[Finding]) -> str:
    parts, at = [], 0
    for start, end, rule in found:
        parts += [text[at:start], f"<{rule}>"]
        at = end
    return "".join(parts) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same documents and columns, each secret replaced by the name of its rule in angle brackets."""
    ship(docs.sparkSession)
    schema, names = docs.schema, docs.columns
    at = names.index(text_col)
    has_length = length_col in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = build_scanner()
        for batch in batches:
            changed: dict[int, str] = {}
            for k, text in enumerate(batch.column(at)):
                s = text.as_py()
                if s and (found := scan(s)):
                    changed[k] = redact(s, found)
            if changed:
                columns = list(batch.columns)
                values = columns[at].to_pylist()
                for k, s in changed.items():
                    values[k] = s
                columns[at] = pa.array(values, columns[at].type)
                if has_length:
                    i = names.index(length_col)
                    counts = columns[i].to_pylist()
                    for k, s in changed.items():
                        counts[k] = len(s)
                    columns[i] = pa.array(counts, columns[i].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, schema)

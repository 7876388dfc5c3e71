"""Secret scan of whole texts: a keyword automaton first, anchored expressions near its hits, then checksums.

An Aho-Corasick automaton over the lower-cased text finds the keywords of all rules in one pass; a rule's expression is
tried only where its keyword stands. Candidates of kinds that embed a checksum or a structure are kept only if it holds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import LOWER, UPPER, read, text_of

_FOLD = str.maketrans(UPPER, LOWER)

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(body: str) -> str:
    """CRC-32 of body in six base-62 digits, as issuers append it to their tokens."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, k = divmod(n, 62)
        out = _BASE62[k] + out
    return out.rjust(6, "0")


def _checked_token(found: str) -> bool:
    body = found.split("_", 1)[1]
    return base62_crc32(body[:-6]) == body[-6:]


def _luhn(found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()]
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and total % 10 == 0


#: Characters of an IBAN by country, as registered; other countries may have any length from 15 to 34.
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 "
        "KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}


def _iban(found: str) -> bool:
    s = found.replace(" ", "")
    return 15 <= len(s) <= 34 and len(s) == IBAN_LENGTHS.get(s[:2], len(s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def _web_token(found: str) -> bool:
    head, body, _ = found.split(".")
    return _json_part(head) and _json_part(body)


#: kind, keyword in lower case, expression, whether it is anchored at the keyword (else it starts within NEAR characters after it, or
#: after an earlier span of its list, and may end after any of its groups), check. An expression that is not anchored matches at most MOST characters.
NEAR, MOST = 48, 64
RULES: list[tuple[str, str, re.Pattern, bool, Callable[[str], bool] | None]] = [
    ("github", "ghp_", re.compile(r"ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), True, _checked_token),
    ("github", "gho_", re.compile(r"gho_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), True, _checked_token),
    ("github", "ghu_", re.compile(r"ghu_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), True, _checked_token),
    ("github", "ghs_", re.compile(r"ghs_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), True, _checked_token),
    ("github", "ghr_", re.compile(r"ghr_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), True, _checked_token),
    ("npm", "npm_", re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), True, _checked_token),
    ("jwt", "eyj", re.compile(r"eyJ[A-Za-z0-9_-]{5,}+\.eyJ[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{8,}+"), True, _web_token),
    ("slack", "xox", re.compile(r"xox[baprs]-[0-9]{8,}+-[A-Za-z0-9-]{10,}+"), True, None),
    ("stripe", "sk_live_", re.compile(r"sk_live_[A-Za-z0-9]{24,}+"), True, None),
    ("private_key", "-----begin ", re.compile(r"-----BEGIN (?:[A-Z]{2,9} )?PRIVATE KEY-----"), True, None),
    ("card", "card", re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}"), False, _luhn),
    ("iban", "iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"), False, _iban),
]
KINDS = ["assign", "access", "hex", *dict.fromkeys(r[0] for r in RULES)]
ASSIGN_KEYS = ["password", "passwd", "secret", "token", "apikey", "api_key"]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    rules: dict[str, list] = {k: [("assign", ASSIGN, True, None)] for k in ASSIGN_KEYS} | {"akia": [("access", ACCESS, True, None)]}
    for kind, key, pattern, anchored, check in RULES:
        rules.setdefault(key, []).append((kind, pattern, anchored, check))
    for key, of in rules.items():
        found.add_word(key, (len(key), of))
    found.make_automaton()
    return found


_AUTOMATON: list = []
_GROUP_END = {"card": re.compile(r"[0-9](?![0-9])"), "iban": re.compile(r"[A-Z0-9](?![A-Z0-9])")}


_KEY_END = re.compile(r"-----END (?:[A-Z]{2,9} )?PRIVATE KEY-----")
_KEY_BLOCK = re.compile(
    r"(?:(?:\s|\\[rn])*+[A-Z][A-Za-z-]*+: [^\n\\]*+)*+"  # Proc-Type and DEK-Info of an encrypted key
    r"(?:(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{40,}+={0,2}+)++(?:(?:[ \t]*+\r?\n|\\r\\n|\\n)[ \t]*+[A-Za-z0-9+/]{1,39}+={0,2}+(?![^\s\\\"'`,;]))?)"
)
_WEB_RUN = re.compile(r"[A-Za-z0-9_-]*+")


def _key_end(text: str, at: int) -> int:
    """Where the private key ends whose BEGIN line ends at at: after its END line, if that is the next line of dashes, else after its base64 block."""
    dashes = text.find("-----", at)
    if dashes >= 0 and (m := _KEY_END.match(text, dashes)):
        return m.end()
    m = _KEY_BLOCK.match(text, at)
    return m.end() if m else at


def _near(text: str, pattern: re.Pattern, group_end: re.Pattern, check: Callable[[str], bool], at: int, limit: int) -> Iterator[tuple[int, int]]:
    """Spans that start from at to limit, each the longest at its start that passes; a span moves the limit to NEAR after its end."""
    while at <= limit and (m := pattern.search(text, at, limit + MOST)) and m.start() <= limit:
        at = m.start() + 1
        # no end of the search here: whether a group ends is seen from the character after it
        for end in reversed([g.end() for g in group_end.finditer(text, m.start(), m.end() + 1) if g.end() <= m.end()]):
            if check(text[m.start() : end]):
                yield m.start(), end
                at, limit = end, max(limit, end + NEAR)
                break


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then by the order of KINDS. Of each kind they are leftmost and do not overlap."""
    if not _AUTOMATON:
        _AUTOMATON.append(automaton())
    ends: dict[str, int] = {}
    tried: dict[str, int] = {}
    spans: list[tuple[str, int, int]] = []
    hits = sorted(((end - n + 1, of) for end, (n, of) in _AUTOMATON[0].iter(text.translate(_FOLD))), key=lambda hit: hit[0]) if text else []
    for at, rules in hits:
        for kind, pattern, anchored, check in rules:
            if not anchored:
                found = list(_near(text, pattern, _GROUP_END[kind], check, max(at, tried.get(kind, 0)), at + NEAR))
                spans += [(kind, *x) for x in found]
                tried[kind] = max(tried.get(kind, 0), (found[-1][1] if found else at) + NEAR + 1)
                continue
            if at < ends.get(kind, 0):
                continue
            m = pattern.match(text, at)
            if not m:
                if kind == "jwt" and text.startswith("eyJ", at):  # nor does it match later in the same run, whose end decides: no run is read twice
                    ends[kind] = _WEB_RUN.match(text, at).end()
                continue
            if kind == "assign" or kind == "access":  # a match uses up its characters even if it is too short
                ends[kind] = m.end()
                if len(m[1]) < ASSIGN_LEAST if kind == "assign" else len(m[0]) < ACCESS_LEAST:
                    continue
            elif check and not check(m[0]):
                continue
            ends[kind] = _key_end(text, m.end()) if kind == "private_key" else m.end()
            spans.append((kind, m.start(), ends[kind]))
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        out = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t.as_py())] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive) of each row.

    A null or empty text has none. Repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_scan, SPANS)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said("spans").alias("spans"))

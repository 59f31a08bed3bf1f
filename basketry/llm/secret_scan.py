"""Secret scans: three fixed patterns, and zstandard novelty of candidates.

Base spans come from the patterns (assignments, access keys, hex runs).  The
method adds spans of kind ``novel``: a candidate is a run of 20 or more
token characters with letters and digits, near a sensitive word or a reported
candidate, or wrapped from a candidate's line to the next.  Its marginal
size is what it adds to the zstandard-compressed surrounding text, with a
dictionary of common identifiers and code words loaded; ordinary words,
repeats of the surrounding text, paths and identifiers add little, random
strings add all that their alphabet has.  That is all their bytes for short
ones; from about 64 bytes on zstandard codes literals by frequency, and a small
alphabet needs fewer bits.  So a candidate is reported that adds at least
``SHARE`` of its own bytes, or at least ``RANDOM_SHARE`` of what a random
string of its length over its own distinct characters adds, unless one base
span covers all of it.  The short last line of a reported PEM body is reported
with it.

Null text is empty; whole texts of any length are scanned, each candidate
against a bounded surrounding; repeated rows give repeated results; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_texts, per_worker

KINDS = ("assign", "access", "hex", "novel")
# fixed patterns of the base spans
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # greedy runs of [A-Z0-9] of 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CONTEXT = re.compile(r"(?i:password|passwd|secret|token|api_?key|credential|private|auth|bearer|access|akia|ssh-)", re.ASCII)
#: Characters before a candidate in which a sensitive word must stand, and those around it that it is measured against.
NEAR, AROUND = 80, 512
#: The last line of a PEM body, too short to be a candidate.
TAIL = re.compile(r"\r?\n([A-Za-z0-9+/=]{1,19})\r?\n-----END")
#: Least marginal bytes per byte: short random strings add all their bytes,
#: words of the dictionary or the surrounding only a reference.
SHARE = 0.75
#: Least marginal bytes per byte that a random string of the same length and
#: characters adds.
RANDOM_SHARE = 0.9
#: Identifiers and code words that a candidate may be made of.
DICTIONARY = " ".join("""the of and to in is for with that this from have not are was but your can all will one about there
public private protected static final class struct interface import export from include return void int long double
float string boolean true false null none self this new delete function def lambda const let var async await yield raise
throw try catch except finally while for each switch case default break continue package module namespace using require
http https www com org net html index main page user username email account address number value name type title content
description version license copyright configuration settings environment development production staging testing database
connection server client request response header body method route handler controller service repository factory manager
provider consumer listener observer builder adapter context session cookie token secret password credential access_key
api_key access_token refresh_token client_id client_secret private_key public_key authorization bearer basic
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx ---------------- ================
________________ getElementById addEventListener querySelector toString valueOf hashCode equals getInstance createElement
application/json text/plain text/html image/png utf-8 ISO-8859-1 max-age no-cache keep-alive multipart/form-data""".split())


class Novelty:
    """Marginal compressed bytes of a candidate after its surrounding and the
    dictionary of identifiers, with which the compressor is primed."""

    def __init__(self, dictionary: str = DICTIONARY):
        self.dictionary = dictionary.encode()

    def is_novel(self, candidate: str, around: str) -> bool:
        """Whether the candidate adds about as much as a random string does."""
        import zstandard
        known = zstandard.ZstdCompressionDict(self.dictionary + b" " + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packed = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
        adds = lambda own: len(packed.compress(own)) - len(packed.compress(b""))
        own = candidate.encode()
        if (added := adds(own)) >= SHARE * len(own):
            return True
        return added >= RANDOM_SHARE * adds(bytes(random.Random(len(own)).choices(sorted(set(own)), k=len(own))))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST] if ":" in text or "=" in text else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Spans of incompressible candidates in a sensitive context that no base span covers whole."""
    out = []
    found = -NEAR - 1  # end of the last reported candidate
    before, sensitive = -1, False  # end of the last candidate, and whether it is in a sensitive context
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        run = m.group()
        wrapped = sensitive and text[before:start] in ("\n", "\r\n")
        sensitive = wrapped or start - found <= NEAR or bool(CONTEXT.search(text, max(0, start - NEAR), start))
        before = end
        if not sensitive or not re.search("[0-9]", run) or not re.search("[A-Za-z]", run):
            continue
        if any(a <= start and end <= b for a, _, b in base):
            found = end
            continue
        around = text[max(0, start - AROUND):start] + text[end:end + AROUND]
        if novelty.is_novel(run, around):
            out.append((start, 3, end))
            found = end
            if tail := TAIL.match(text, end):
                out.append((tail.start(1), 3, tail.end(1)))
    return out


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, of a text in order of start and kind."""
    base = base_spans(text)
    new = novel_spans(text, base, per_worker("novelty", Novelty)) if CONTEXT.search(text) else []
    return base, sorted(base + new)


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id and ``found array<struct<kind, start, end, base>>`` with
    positions in code points, end exclusive."""

    def rows(part, texts):
        found = []
        for t in texts:
            base, spans = find(t)
            known = set(base)
            found.append([{"kind": KINDS[s[1]], "start": s[0], "end": s[2], "base": s in known} for s in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["id", "found"])

    kind = df.schema[id_column].dataType.simpleString()
    return map_texts(df.select(id_column, text_column), text_column, rows, f"`{id_column}` {kind}, found array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")


def scan_digests(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``scan`` as counts, a digest of the base spans and the list of all."""
    found = scan(df, id_column, text_column)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    return found.select(id_column, *map(count, KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def redact(df: DataFrame, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The table with every found span replaced by ``mask``, all columns and
    null texts kept."""

    def rows(part, texts):
        out = []
        for t, raw in zip(texts, part.column(text_column).to_pylist()):
            at, kept = 0, []
            for a, _, b in find(t)[1]:
                if a >= at:
                    kept += [t[at:a], mask]
                at = max(at, b)
            out.append(None if raw is None else "".join(kept) + t[at:])
        place = part.schema.get_field_index(text_column)
        return part.set_column(place, text_column, pa.array(out, pa.string()))

    return map_texts(df, text_column, rows, df.schema)

"""Personal data by candidate generation and gradient-boosted trees.

``base_spans`` finds the spans that fixed formats settle (email, ip, card,
phone). Formats read greedily miss data that stands side by side, such as a
phone number followed by a card number, and data written in other ways. So
generators of high recall propose spans that overlap: every run of up to 19
digits that starts and ends at a digit group, four dotted groups, addresses with
"@" or a bracketed "at". Each proposal has format features (digits, groups,
separators, checksum, octets) and context features (neighbouring characters,
digits beyond the ends). Boosted trees (Spark ML) score them; the
threshold of each kind is the lowest that reaches ``precision`` on held-out
rows; what passes and does not overlap a base span or a better proposal is added.

There are no hand-made labels. Right are base spans, base spans written in other
formats in their places (``rewritten``: bracketed at and dot, phones without
"+" and with other separators, cards of 15 digits), and two base spans of a
document set side by side, in either order. Wrong are proposals that overlap
these without being equal, and numbers that are clearly not personal
(``settled``: failed checksums, octets over 255, dates, years, versions, round
numbers, undivided digits), of the corpus or put in the places of base spans
(``decoys``). Other proposals of the corpus have no label and are not trained on.
Phones written as undivided digits without "+" are therefore not found.
All documents are searched for them and all that they yield is used: a quarter, by hash,
sets the thresholds, the rest fits the trees. Equal rows (features and label) are one row with
their number as its weight. Base spans always stay.

Texts without "@", a bracketed "at" or seven characters of a number hold neither base spans
nor proposals and are not sent to Python. Tasks hand on what they found every ``PIECE`` spans.

Cases: a null text is an empty one; offsets are code points, end exclusive;
every search is linear in the text; repeated rows and ids are documents of
their own; no candidates, or labels of one class only, add nothing; an empty
table gives an empty table; other columns are ignored or carried by ``keep``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..session import materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE_AT = re.compile(r"@[A-Za-z0-9-]+|[ ]?[(\[{][ ]?(?:at|AT)[ ]?[)\]}][ ]?[A-Za-z0-9-]+"
                       r"(?:(?:\.|[ ]?[(\[{][ ]?(?:dot|DOT)[ ]?[)\]}][ ]?)[A-Za-z0-9-]+)*")
_ZONE = re.compile(r"[0-9]+(?:[ ().-]{1,3}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")

#: What a text with a base span or a proposal holds: each number among them is seven characters of these or more.
_MAY = r"@|[0-9][ ().0-9-]{6}|[(\[{][ ]?(?:at|AT)[ ]?[)\]}]"

#: Spans that a task holds before it hands them on.
PIECE = 2_000

Span = tuple[int, int, int]
SPANS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("kind", "start", "end")]))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _local_start(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[Span]:
    """Base spans as (kind, start, end), ordered by kind and start."""
    out: list[Span] = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            # The run before "@" is the whole local part: no shorter one can stand before "@".
            start = _local_start(text, m.start(), done)
            if start < m.start():
                out.append((EMAIL, start, m.end()))
                done = m.end()
    # A number that fails from its first digit fails from its other digits too, so IPs start at a first digit.
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 16 <= len(d) <= 19 and _luhn(d):
            out.append((CARD, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append((PHONE, *m.span()))
    return out


def candidate_spans(text: str) -> list[Span]:
    """Overlapping proposals; their number is linear in the text."""
    out: list[Span] = []
    floor = 0
    for m in _LOOSE_AT.finditer(text):
        start = _local_start(text, m.start(), floor)
        if start < m.start():
            end = m.end()
            while end < len(text) and text[end] == "." and end + 1 < len(text) and text[end + 1] in _LOCAL:
                end += 1
                while end < len(text) and text[end] in _LOCAL and text[end] != ".":
                    end += 1
            out.append((EMAIL, start, end))
            floor = end
    for zone in _ZONE.finditer(text):
        if zone.end() - zone.start() < 7:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, zone.start(), zone.end())]
        for i, (start, _) in enumerate(groups):
            n = 0
            for j in range(i, min(len(groups), i + 19)):
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                end = groups[j][1]
                seps = {text[groups[k][1]:groups[k + 1][0]] for k in range(i, j)}
                if j - i == 3 and seps == {"."}:
                    out.append((IP, start, end))
                if n >= 13 and seps <= {" ", "-"}:
                    out.append((CARD, start, end))
                if 8 <= n <= 15 and (seps or n <= 12):
                    lead = start
                    while lead and text[lead - 1] in "(+":
                        lead -= 1
                    out.append((PHONE, lead, end))
    return out


def _kind_of(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal."""
    kind, a, b = span
    s = text[a:b]
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    digits = _digits(s)
    before, after = text[max(0, a - 30):a], text[b:b + 30]
    prior, later = before.rstrip(" ().-")[-1:], after.lstrip(" ().-")[:1]
    plausible = not settled(text, span)
    whole = s.count("(") == s.count(")") and not prior.isdigit() and not later.isdigit()
    octets = [int(x) for x in re.findall(r"[0-9]+", s) if len(x) <= 4]
    return [float(x) for x in (
        kind, b - a, len(digits), len(groups), groups[0], groups[-1], max(groups), min(groups),
        s.startswith("+"), s.count("("), s.count("-"), s.count(" "), s.count("."), s.count("@"),
        _dots(s) if kind == EMAIL else -1, plausible, plausible and whole,
        13 <= len(digits) <= 19 and _luhn(digits), int(digits[:1] or -1),
        sum(o <= 255 for o in octets) if kind == IP else -1,
        _kind_of(before[-1:]), _kind_of(after[:1]), prior.isdigit(), later.isdigit())]


_DATE = re.compile(r"(?:(?:1[0-9]|20)[0-9]{2}([-./ ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])"
                   r"|(?:0?[1-9]|[12][0-9]|3[01])([-./ ])(?:0?[1-9]|1[0-2])\2(?:1[0-9]|20)[0-9]{2}"
                   r"|(?:0?[1-9]|1[0-2])([-./ ])(?:0?[1-9]|[12][0-9]|3[01])\3(?:1[0-9]|20)[0-9]{2})(?![0-9])")
_YEARS = re.compile(r"(?:1[0-9]|20)[0-9]{2}[ -]{1,3}(?:1[0-9]|20)[0-9]{2}")
_DOT = re.compile(r"\.|[(\[{][ ]?(?:dot|DOT)[ ]?[)\]}]")


def _dots(address: str) -> int:
    """Dots of an address behind its "at", in any format."""
    at = _LOOSE_AT.search(address)
    return len(_DOT.findall(address, at.start())) if at else 0


def settled(text: str, span: Span) -> bool:
    """Whether a proposal is clearly not personal."""
    kind, a, b = span
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    if kind == EMAIL:
        return not _dots(s)
    if kind == IP:
        return any(len(g.lstrip("0")) > 3 or int(g) > 255 for g in groups)
    if kind == CARD:
        return not _luhn(_digits(s))
    return (len(groups) == 1 or bool(_DATE.match(s)) or bool(_YEARS.fullmatch(s)) or "000" in groups[1:]
            or any(len(g) == 1 for g in groups[1:]))


def rewritten(kind: int, s: str) -> list[str]:
    """A base span in formats that its search does not know."""
    if kind == EMAIL:
        local, host = s.split("@", 1)
        return [f"{local}{at}{host.replace('.', dot)}" for at, dot in (
            (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" {at} ", " {dot} "), (" (at) ", "."),
            (" [AT] ", " [DOT] "))]
    if kind == PHONE:
        code, *rest = re.findall(r"[0-9]+", s)
        if len(rest) < 2 or len("".join(rest)) < 8:
            return []
        joined = [sep.join(rest) for sep in ("-", ".", " ")]
        return [f"({rest[0]}) {'-'.join(rest[1:])}", f"({rest[0]}) {' '.join(rest[1:])}", *joined,
                f"{code}-{joined[0]}", f"{code} ({rest[0]}) {'-'.join(rest[1:])}"]
    if kind == CARD:
        d = "3" + _digits(s)[1:14]
        d += next(str(c) for c in range(10) if _luhn(d + str(c)))
        return [d, f"{d[:4]} {d[4:10]} {d[10:]}", f"{d[:4]}-{d[4:10]}-{d[10:]}"]
    return []


def decoys(kind: int, s: str) -> list[str]:
    """Texts that stand where a base span did and are not personal."""
    if kind == EMAIL:
        local, host = s.split("@", 1)
        name = host.split(".")[0]
        return [f"{local} (at) {name}", f"{local} [at] {name}", f"{local}@{name}"]
    d = _digits(s)
    if kind == IP:
        return [".".join(str(int(g[-3:]) + 256) for g in re.findall(r"[0-9]+", s))]
    if kind == CARD:
        return [re.sub(r"[0-9]$", lambda m: str((int(m.group()) + 1) % 10), s)]
    x = int(d)
    year, month, day = 1950 + x % 90, 1 + x % 12, 1 + x % 28
    return [f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{month:02d}/{day:02d}/{year}",
            f"{year}-{year + 3}", f"{d[:2]} {d[2:5]} 000", f"{d[:3]} 000 000", f"{d[:2]}.{d[2]}.{d[3:5]}.{d[5:8]}", d]


def sweep(spans: list[tuple[int, int]]):
    """Whether a stretch overlaps one of ``spans``: a search in their starts and the farthest end up to each."""
    spans = sorted(spans)
    starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def overlaps(start: int, end: int) -> bool:
        at = bisect_left(starts, end)
        return at > 0 and reach[at - 1] > start

    return overlaps


def _scan(batches: Iterator[pd.DataFrame], keep: list[str]) -> Iterator[pd.DataFrame]:
    """Base spans, proposals and the number of proposals whose label is known."""
    for pdf in batches:
        base_out, cand_out, known_out, done, held = [], [], [], 0, 0
        for at, text in enumerate(pdf["_text"], 1):
            text = "" if text is None else text
            base = base_spans(text)
            known = set(base)
            overlaps = sweep([(a, b) for _, a, b in base])
            cands, n = [], 0
            for c in candidate_spans(text):
                free = c not in known and not overlaps(c[1], c[2])
                n += not free or settled(text, c)
                if free:
                    cands.append({"kind": c[0], "start": c[1], "end": c[2], "f": features(text, c)})
            base_out.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            cand_out.append(cands)
            known_out.append(n)
            held += len(base) + len(cands)
            if held >= PIECE or at == len(pdf):
                out = pdf[keep].iloc[done:at].copy()
                out["base"], out["cands"], out["known"] = base_out, cand_out, known_out
                yield out
                base_out, cand_out, known_out, done, held = [], [], [], at, 0


def training_rows(text: str) -> list[dict]:
    """Proposals of a text whose label is known, of its numbers put side by side, and of its base spans rewritten."""
    base = base_spans(text)
    known = set(base)
    overlaps = sweep([(a, b) for _, a, b in base])
    train = []
    for c in candidate_spans(text):
        if c in known or overlaps(c[1], c[2]) or settled(text, c):
            train.append({"right": float(c in known), "f": features(text, c)})
    numbers = [s for s in base if s[0] != EMAIL]
    for x, y in [p for q in zip(numbers, numbers[1:]) for p in (q, q[::-1])]:
        if x[2] <= y[1] or y[2] <= x[1]:
            left, first, second = text[max(0, x[1] - 40):x[1]], text[x[1]:x[2]], text[y[1]:y[2]]
            made = f"{left}{first} {second}{text[y[2]:y[2] + 40]}"
            at = len(left) + len(first) + 1
            true = {(x[0], len(left), at - 1), (y[0], at, at + len(second))}
            train += [{"right": float(c in true), "f": features(made, c)} for c in candidate_spans(made)
                      if c[1] >= len(left) and c[2] <= at + len(second)]
    for kind, a, b in base:
        s, pick = text[a:b], crc32(text[a:b].encode("utf-8", "surrogatepass"))
        left, right = text[max(0, a - 40):a], text[b:b + 40]
        for made, true in ((rewritten(kind, s), True), (decoys(kind, s), False)):
            if made:  # every span is used, in one of the formats
                new = made[pick % len(made)]
                span, whole = (kind, len(left), len(left) + len(new)), left + new + right
                train += [{"right": float(true and c == span), "f": features(whole, c)}
                          for c in candidate_spans(whole) if c[1] >= span[1] and c[2] <= span[2]]
    return train


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        docs, found, held = [], [], 0
        for doc, text in zip(pdf["doc"], pdf["_text"]):
            rows = training_rows("" if text is None else text)
            if rows:
                docs.append(doc)
                found.append(rows)
                held += len(rows)
            if held >= PIECE:
                yield pd.DataFrame({"doc": docs, "train": found})
                docs, found, held = [], [], 0
        if docs:
            yield pd.DataFrame({"doc": docs, "train": found})


def scan_documents(docs: DataFrame, keep: dict[str, str], text_col: str) -> DataFrame:
    """Written rows: the columns of ``keep`` (new name to old), a row number, base spans, proposals, ``known``."""
    source = docs.select(*[F.col(c).alias(n) for n, c in keep.items()],
                         F.when(F.col(text_col).rlike(_MAY), F.col(text_col)).alias("_text"))
    names = list(keep)
    schema = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    found = source.mapInPandas(
        lambda batches: _scan(batches, names),
        f"{schema}, base array<struct<kind: int, start: int, end: int>>, "
        "cands array<struct<kind: int, start: int, end: int, f: array<double>>>, known long")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "pii_scan")


def draw_training(docs: DataFrame, scan: DataFrame, id_col: str, text_col: str, train_rows: int | None = None) -> DataFrame:
    """Written ``right, f, h``: all that is made from all documents. ``train_rows``, for trials only, draws documents by a
    hash of id and text, as many as hold about so many proposals of known label."""
    doc = F.xxhash64(F.col(id_col), F.col(text_col))
    texts = docs.select(doc.alias("doc"), F.col(text_col).alias("_text")).filter(F.col("_text").rlike(_MAY))
    if train_rows is not None:
        known = scan.agg(F.sum("known")).first()[0] or 0
        part = int(min(1.0, train_rows / max(known, 1)) * (1 << 20))
        texts = texts.filter(F.pmod(F.shiftright("doc", 22), F.lit(1 << 20)) < part)
    rows = texts.mapInPandas(_train, "doc long, train array<struct<right: double, f: array<double>>>")
    rows = rows.select("doc", F.posexplode("train").alias("at", "t")).select(
        "t.right", "t.f", F.xxhash64("doc", "at").alias("h"))
    return materialize(rows, "pii_drawn")


def train_model(rows: DataFrame, trees: int, depth: int, precision: float):
    """The model and the threshold per kind, from all ``rows``; None where labels are missing."""
    held = F.pmod(F.shiftright("h", 20), F.lit(4)) == 0
    table = materialize(rows.groupBy("right", "f", held.alias("held")).agg(F.count(F.lit(1)).cast("double").alias("n"))
                        .sortWithinPartitions("right", "f", "held")
                        .select(array_to_vector("f").alias("features"), "right",
                                F.col("f")[0].cast("int").alias("kind"), "held", "n"), "pii_train")
    fit = table.filter("not held")
    if fit.select("right").distinct().count() < 2:
        return None, {}
    model = GBTClassifier(featuresCol="features", labelCol="right", weightCol="n", maxIter=trees, maxDepth=depth,
                          stepSize=0.3, seed=42).fit(fit)
    bins = (model.transform(table.filter("held"))
            .groupBy("kind", F.floor(vector_to_array("probability")[1] * 100).alias("bin"))
            .agg(F.sum(F.col("right") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect())  # 404 rows at most
    limits = {}
    for kind in range(len(KINDS)):
        right = n = 0
        for b in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            right, n = right + b["right"], n + b["n"]
            if right >= precision * n and b["bin"] >= 50:
                limits[kind] = b["bin"] / 100
    return model, limits


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       keep: tuple[str, ...] = (), train_rows: int | None = None, trees: int = 12,
                       depth: int = 4, precision: float = 0.99) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of kind, start, end ordered by
    kind and start; spans holds base and added ones), and ``keep`` as ``keep_*``."""
    scan = scan_documents(docs, {"id": id_col, **{f"keep_{c}": c for c in keep}}, text_col)
    model, limits = train_model(draw_training(docs, scan, id_col, text_col, train_rows), trees, depth, precision)
    if limits:
        cands = scan.select("row", F.explode("cands").alias("c")).select("row", "c.*", array_to_vector("c.f").alias("features"))
        low = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()], F.lit(2.0))
        good = (model.transform(cands).withColumn("p", vector_to_array("probability")[1])
                .filter(F.col("p") >= low).select("row", "kind", "start", "end", "p"))
        added = materialize(good.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "p")).alias("good"))
                            .select("row", _best("good").alias("added")), "pii_added")
        scan = scan.join(added, "row", "left")
    else:
        scan = scan.withColumn("added", F.lit(None).cast(SPANS))
    spans = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(SPANS))))
    return scan.select(F.col("id").alias("doc_id"), "base", spans.alias("spans"), *[f"keep_{c}" for c in keep])


@pandas_udf(SPANS)
def _best(groups: pd.Series) -> pd.Series:
    """The best proposals of a document that do not overlap: the likeliest first, then the longest."""
    out = []
    for group in groups:
        starts, chosen = [], []  # what is chosen does not overlap, so the nearest before is all there is to look at
        for c in sorted(group, key=lambda c: (-c["p"], c["start"] - c["end"], c["start"], c["kind"])):
            at = bisect_left(starts, c["end"])
            if not at or chosen[at - 1]["end"] <= c["start"]:
                starts.insert(at, c["start"])
                chosen.insert(at, {k: int(c[k]) for k in ("kind", "start", "end")})
        out.append(chosen)
    return pd.Series(out)


def span_text(spans):
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@pandas_udf(StringType())
def redact(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with each span replaced by its kind in brackets; spans that overlap become one."""
    out = []
    for text, found in zip(texts, spans):
        if text is None or found is None or not len(found):
            out.append(text)
            continue
        parts, at = [], 0
        for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                parts += [text[at:s["start"]], f"[{KINDS[s['kind']].upper()}]"]
            at = max(at, s["end"])
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out)


def redacted_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data replaced; ``n_chars``, if there, is recomputed."""
    cols = docs.columns
    found = find_personal_data(docs, keep=tuple(cols), **options).withColumn("_clean", redact("keep_text", "spans"))
    return found.select(*[F.col("_clean").alias(c) if c == "text" else
                          F.length("_clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
                          F.col(f"keep_{c}").alias(c) for c in cols])


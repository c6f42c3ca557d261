"""Personal data: exact patterns first, then boosted trees over generously proposed spans.

Generators propose overlapping spans that look like an address, a card, a phone or a network number, also in forms
that the exact patterns miss. Trees are boosted on spans whose nature the patterns settle: exact matches against spans
that cannot be personal data, such as sixteen digits without a valid checksum. They see format and context, not
which pattern matched, and also learn from every exact match written in other ways, and from strings of its digits
that are no personal data, in the same context; so they carry over to spelled-out addresses and to other separators. A threshold per kind is calibrated on rows kept out of the fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.functions.ranges import running
from shiftframe.functions.workspace import materialize

KINDS = ("email", "ip", "card", "phone")
LEAST_PRECISION = 0.99
LEAST_SCORE = 0.5

# fixed values: the exact patterns; the first is searched from its @, and possessive runs cannot change a match
AT_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

AT_WORD = re.compile(r"(?:[\[({<] ?| )(?:at|AT|arroba|arobase)(?: ?[\])}>]| )")
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?@ ?| ?[\[({<] ?(?:at|AT|arroba|arobase) ?[\])}>] ?| (?:at|AT) )"
    r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|DOT|punto|point) ?[\])}>] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{1,63})+"
)
PLAIN = re.compile(r" at [A-Za-z0-9-]+\.")
DIGITS = re.compile(r"[+(]?[0-9](?:[ ().,:/_-]{0,2}[0-9])++")
HINTS = re.compile(r"(?i)\b(?:mail|contact|tel|phone|call|fax|mobile|card|visa|credit|ip|host|server|address)\b")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact matches, kinds as in ``KINDS``: leftmost and non-overlapping within a kind."""
    found, used = [], 0
    for m in AT_HOST.finditer(text) if "@" in text else ():
        start = m.start()
        while start > used and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            used = m.end()
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def proposals(text: str) -> set[tuple[int, int, int]]:
    """(start, kind, end) of everything that might be personal data; spans may overlap."""
    found = set()
    if "@" in text or AT_WORD.search(text):
        found |= {(m.start(), 0, m.end()) for m in SPELLED.finditer(text)}
    for m in DIGITS.finditer(text):
        n = sum("0" <= c <= "9" for c in m[0])
        groups = len(re.findall("[0-9]+", m[0]))
        if 4 <= n <= 12 and groups == 4:
            found.add((m.start(), 1, m.end()))
        if 8 <= n <= 24:
            found.add((m.start(), 2, m.end()))
        if 4 <= n <= 18:
            found.add((m.start(), 3, m.end()))
    return found


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format, checksum and context of a span; nothing says whether an exact pattern matched it."""
    before, after = text[max(0, start - 24) : start], text[end : end + 8]
    start += text[start] == "+"  # a prefix says nothing here, so numbers without one look alike
    while kind == 0 and start < end - 1 and text[start] in LOCAL_CHARS:
        start += 1  # nor does the name in an address
    span = text[start:end]
    groups = [len(g) for g in re.findall("[0-9]+", span)] if kind else [0]
    groups = groups or [0]
    words = re.findall("[A-Za-z]+", span)
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        float(sum(groups)), float(len(groups)), float(max(groups)), float(min(groups)), float(groups[-1]),
        float(end - start), float(len(words)), float(len(words[-1]) if words else 0),
        float(span.count(".")), float(span.count("-")), float(span.count(" ")), float("(" in span), float("/" in span or ":" in span or "," in span),
        float(before[-1:].isalnum() or before[-1:] in ("=", '"', "_")), float(after[:1].isalnum() or after[:1] in ('"', "_", "%")),
        float(bool(HINTS.search(before))),
        float(kind == 2 and luhn(re.sub("[^0-9]", "", span))),
    ]


def settled(kind: int, exact: bool, row: list[float], span: str) -> int:
    """1 for an exact match, 0 for a span that cannot be personal data of its kind, -1 where nothing is known."""
    if exact:
        return 1
    digits, groups, joined = row[4], row[5], row[17] or row[18]
    if kind == 0:  # a sentence that lacks the blank after its full stop, rather than an address spelled out
        return 0 if PLAIN.search(span) else -1
    if kind == 1:
        impossible = row[6] > 3 or any(int(part) > 255 for part in re.findall("[0-9]{1,3}", span))
    elif kind == 2:
        impossible = digits < 12 or digits > 19 or not row[20]
    else:
        impossible = digits < 7 or digits > 15
    return 0 if joined or impossible or (kind == 3 and groups == 4 and row[12] == 3) or (kind == 3 and digits >= 13 and groups == 1) else -1


def rewritten(kind: int, span: str) -> tuple[list[str], list[str]]:
    """(other ways to write this personal data, strings of the same digits that are none)."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        local, host = span.split("@")
        ways = [(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", ".")]
        return [local + at + host.replace(".", dot) for at, dot in ways], [f"{local} at {host}"]
    if kind == 1:
        return [span.replace(".", sep) for sep in (" . ", "-", ". ", ":")], [span.replace(".", ", "), " ".join(f"{p[:1]}.{p[-1:]}" for p in span.split("."))]
    if kind == 2:
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        none = str((int(digits[-1]) + 3) % 10)
        return [sep.join(groups) for sep in (".", "/", " - ", "_")], [sep.join(groups)[:-1] + none for sep in (".", "/", "_")]
    code, area, middle, last = digits[:-10] or "1", digits[-10:-7], digits[-7:-4], digits[-4:]
    ways = [f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}", f"{area} {middle} {last}",
            f"{code}-{area}-{middle}-{last}", f"{code} ({area}) {middle}-{last}", f"{code} {area} {middle} {last}"]
    day = f"20{digits[:2]}-{int(digits[2]) + 1:02d}-{int(digits[3]) + 10}"
    return ways, [
        day, f"{day} 1{digits[4]}:3{digits[5]}:4{digits[6]}", *(f"{digits[:n]},{digits[n:n + 3]},{digits[n + 3:n + 6]}.{digits[7:9]}" for n in (1, 2, 3)), digits[:9], digits[:7],
        " ".join(f"{d}.{e}" for d, e in zip(digits, digits[1:6])), f"{digits[:3]}-{digits[3:6]}, {digits[6:9]}", ".".join(digits[:5]),
    ]


def rehearsed(text: str, start: int, kind: int, end: int) -> list[tuple[int, int, list[float]]]:
    """(kind, label, format and context) of an exact match written otherwise in its own place, for the fit only."""
    ways, others = rewritten(kind, text[start:end])
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    made = []
    for way in ways:
        whole, stop = before + way + after, len(before) + len(way)
        made.append((kind, 1, describe(whole, len(before), kind, stop)))
        made += [(k, 0, describe(whole, a, k, b)) for a, k, b in sorted(proposals(whole)) if (a, b) == (len(before), stop) and k != kind]
    for other in others:
        whole, stop = before + other + after, len(before) + len(other)
        made += [(k, 0, describe(whole, a, k, b)) for a, k, b in sorted(proposals(whole)) if a >= len(before) and b <= stop]
    return made


SCANNED = "row long, doc_id {id}, base array<struct<start:int,kind:int,end:int>>, proposed array<struct<start:int,kind:int,end:int,label:int,x:array<double>>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact and proposed spans of every whole text, numbered by row; written down, as the trees read it twice.

    Spans with a negative start are rewritings of an exact match that only the fit sees.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    proposed_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))]))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in found:
            base, proposed = [], []
            for value in batch.column(1):
                content = value.as_py() or ""
                exact = base_spans(content)
                base.append([dict(zip(("start", "kind", "end"), s)) for s in exact])
                own = []
                for span in sorted(proposals(content) | set(exact)):
                    x = describe(content, *span)
                    own.append(dict(zip(("start", "kind", "end", "label", "x"), (*span, settled(span[1], span in exact, x, content[span[0] : span[2]]), x))))
                for span in exact:
                    own += [
                        {"start": -1 - i, "kind": k, "end": span[2], "label": label, "x": x}
                        for i, (k, label, x) in enumerate(rehearsed(content, *span))
                    ]
                proposed.append(own)
            rows = pa.array(np.arange(row, row + len(batch)))
            row += len(batch)
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), pa.array(base, base_type), pa.array(proposed, proposed_type)], names=["row", "doc_id", "base", "proposed"]
            )

    return materialize(narrow.mapInArrow(batches, SCANNED.format(id=kind)), "pii-spans")


def least_scores(judged: DataFrame) -> dict[int, float]:
    """Per kind the lowest score down to which the labels of ``judged`` (kind, label, n, p) are right often enough.

    Rows of one score count together, ``n`` times each. Sums run over ranges, so no task gets all rows of a kind; one
    row per kind comes to the driver.
    """
    scores = judged.groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("hits"))
    summed = running(scores, ["kind"], [F.col("p").desc()], {"seen": F.col("n"), "right": F.col("hits")})
    good = summed.where(F.col("right") >= F.col("seen") * LEAST_PRECISION).groupBy("kind").agg(F.min("p").alias("p"))
    found = {r.kind: r.p for r in good.collect()}
    return {kind: max(LEAST_SCORE, found[kind]) if kind in found else 2.0 for kind in range(len(KINDS))}


def select_spans(spans: DataFrame, sample_rows: int | None = None) -> DataFrame | None:
    """``row, start, kind, end`` of proposed spans that the trees add: in no exact match and above their threshold.

    Fits on all settled spans; a quarter of them, by hash of id and place, sets the thresholds instead. Spans that look alike
    are one row that counts as often as they occur, so the fit grows with the different forms and not with the
    spans. ``sample_rows`` is for callers who want a quicker fit on that many spans, chosen by hash. What settles a label is
    no filter: the trees judge every span outside exact matches. Without both labels nothing is added.
    """
    settled_rows = spans.where("label >= 0")
    if sample_rows is not None:
        place = ["doc_id", "start", "kind", "end"]
        settled_rows = settled_rows.orderBy(F.xxhash64(*place), *place, "x").limit(sample_rows)
    apart = (F.pmod(F.xxhash64("start", "doc_id"), F.lit(4)) == 0).alias("apart")
    alike = ["kind", "label", "x", "apart"]
    counted = settled_rows.select("kind", F.col("label").cast("double").alias("label"), "x", apart).groupBy(*alike).agg(F.count(F.lit(1)).alias("n"))
    # dealt by content and sorted, so that the fit does not depend on how the rows lie
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartition(tasks, *alike).sortWithinPartitions(*alike)
    chosen = materialize(dealt.select("kind", "label", "apart", "n", array_to_vector("x").alias("features")), "pii-forms")
    if chosen.where("not apart").select("label").distinct().count() < 2:
        return None
    fitted = chosen.where("not apart").select("label", "features", F.col("n").cast("double").alias("n"))
    model = GBTClassifier(maxIter=16, maxDepth=5, seed=3, featureSubsetStrategy="all", weightCol="n").fit(fitted)
    probability = vector_to_array("probability")[1]
    limits = least_scores(model.transform(chosen.where("apart")).select("kind", "label", "n", probability.alias("p")))
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)]), F.col("kind"))
    open_ = spans.where("start >= 0 and not overlaps").withColumn("features", array_to_vector("x"))
    return model.transform(open_).where(probability >= limit).select("row", "start", "kind", "end")


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    Counts and digest cover the exact matches; ``spans`` also holds what the trees add. Null and empty texts have no
    spans; repeated rows are judged each; an empty table gives no rows. Other columns are not read. The fit takes all
    settled spans unless ``sample_rows`` bounds it.
    """
    scanned = scan(docs, key, text)
    touching = F.exists("base", lambda b: (b["start"] < F.col("p.end")) & (F.col("p.start") < b["end"]))
    spans = scanned.select("row", "doc_id", "base", F.explode("proposed").alias("p")).select("row", "doc_id", "p.*", touching.alias("overlaps"))
    added = select_spans(spans, sample_rows)
    if added is not None:
        more = added.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
        scanned = scanned.join(more, "row", "left")
    else:
        scanned = scanned.withColumn("more", F.lit(None).cast("array<struct<start:int,kind:int,end:int>>"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(found):
        return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return scanned.select(
        "doc_id", *map(count, range(len(KINDS))), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"),
    )

"""Personal data: exact base patterns seed a bootstrap that learns the words around them and finds further identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text
from .token_files import slices

#: the kinds in their order
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
RUN = re.compile(r"[0-9@]+")
#: groups of digits, some in brackets, joined by single blanks, dots and hyphens
GROUPS = re.compile(r"\+?(?:\([0-9]+\)|[0-9]+)(?:[\x20.-]?\([0-9]+\)|[\x20.-][0-9]+|(?<=\))[0-9]+)+")
BLANK = " \t\n\v\f\r"
OPENS = "=:\"'<>()[]{}|"
TRIM = ".,;:!?\"'()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base matches, leftmost and non-overlapping within each kind, by start and kind."""
    if not SIGN.search(text):
        return []
    out = []
    if "@" in text:
        out += [(*m.span(), 0) for m in EMAIL.finditer(text)]
    # no part of an address may be above 255, however it is written
    out += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        out += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _word_before(text: str, at: int) -> tuple[str, int]:
    end = at
    while end > 0 and text[end - 1] in BLANK:
        end -= 1
    start = end
    while start > 0 and text[start - 1] not in BLANK and end - start < 64:
        start -= 1
    return text[start:end].lower(), start


def _word_after(text: str, at: int) -> str:
    start = at
    while start < len(text) and text[start] in BLANK:
        start += 1
    end = start
    while end < len(text) and text[end] not in BLANK and end - start < 64:
        end += 1
    return text[start:end].lower()


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns an occurrence lies in: two words before, one before and one after, and a label glued to it."""
    glued = start
    while glued > 0 and text[glued - 1] not in BLANK and start - glued < 64:
        glued -= 1
    before, at = _word_before(text, glued)
    further, _ = _word_before(text, at)
    stop = end
    while stop < len(text) and text[stop] not in BLANK and stop - end < 64:
        stop += 1
    label, after = text[glued:start].lower(), _word_after(text, stop)
    found = [f"<|{further} {before} {label}", f"<>|{before} {label}|{after}"]
    return found + ([f"=|{label}"] if len(label) > 2 else [])


def group_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of digit groups that make one number together: 19 digits at most, apart from other words.

    Where each part between blanks has seven digits or more, the parts are numbers of their own.
    """
    out = []
    for m in GROUPS.finditer(text):
        start, end = m.span()
        parts = [sum(c.isdigit() for c in p) for p in m.group().split(" ")]
        if (len(parts) == 1 and "(" not in m.group()) or sum(parts) > 19 or (len(parts) > 1 and min(parts) >= 7):
            continue
        rest = end
        while rest < len(text) and text[rest] in TRIM:
            rest += 1
        if (start == 0 or text[start - 1] in BLANK or text[start - 1] in OPENS) and (rest == len(text) or text[rest] in BLANK):
            out.append((start, end))
    return out


def occurrences(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind or -1, instance, patterns) of the base spans, and of every other number in groups or word with a digit or an at sign."""
    for start, end, kind in base:
        yield start, end, kind, text[start:end].lower(), contexts(text, start, end)
    groups = [g for g in group_spans(text) if not any(s < g[1] and g[0] < e for s, e, _ in base)]
    done = at = 0
    for m in RUN.finditer(text):
        if m.start() < done:
            continue
        while at < len(groups) and groups[at][1] <= m.start():
            at += 1
        if at < len(groups) and done <= groups[at][0] <= m.start():
            start, done = groups[at]
            if done - start >= 4:
                yield start, done, -1, text[start:done].lower(), contexts(text, start, done)
            continue
        start, end = m.start(), m.end()
        while start > done and text[start - 1] not in BLANK and text[start - 1] not in OPENS:
            start -= 1
        while end < len(text) and text[end] not in BLANK:
            end += 1
        done = end
        while end > start and text[end - 1] in TRIM:
            end -= 1
        while start < end and text[start] in TRIM:
            start += 1
        if end - start >= 4 and not any(s < end and start < e for s, e, _ in base):
            yield start, end, -1, text[start:end].lower(), contexts(text, start, end)


OCCURRENCE = "array<struct<start: int, end: int, kind: int, instance: string, patterns: array<string>>>"
_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("start", "end", "kind", "instance", "patterns")
    for batch in batches:
        for part in slices(batch, 0):
            rows = []
            for text in part.column(0).to_pylist():
                rows.append([dict(zip(names, o)) for o in occurrences(text, base_spans(text))] if SIGN.search(text) else [])
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(rows, _TYPE)], [*part.schema.names[1:], "found"])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, row_no, found``: base spans (kind 0 to 3) and candidates (kind -1) of every whole text."""
    rows = df.select(whole_text(text_col).alias("text"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_no"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_find, f"id {kind}, row_no bigint, found {OCCURRENCE}")


def fits(instance: Column, kind: Column) -> Column:
    """Whether an instance could be of a kind by its looks: written another way than the base patterns ask, or mistyped."""
    n_digits = F.length(F.regexp_replace(instance, "[^0-9]", ""))
    looks = (
        instance.rlike("@|[^a-z0-9]at[^a-z0-9]"),
        instance.rlike(r"^[0-9a-fx*]*([.:][0-9a-fx*]*){3,}(/[0-9]+)?$"),
        instance.rlike(r"^[0-9 .-]+$") & n_digits.between(12, 19),
        instance.rlike(r"^[0-9 ()+./-]+$") & n_digits.between(7, 15),
    )
    return F.coalesce(*(F.when(kind == k, look) for k, look in enumerate(looks)), F.lit(False))


def bootstrap(found: DataFrame, rounds: int = 3, min_support: int = 5, min_confidence: float = 0.8) -> DataFrame:
    """``pattern, kind, confidence`` of the patterns that a bootstrap trusts.

    Edges join distinct instances with the patterns they occur in.  Base instances belong to their kind for good;
    others start at zero.  Each round scores a pattern for a kind by what speaks for it, the sum of the scores of its
    distinct instances, against what speaks against it, shrunk by one unknown: base instances of other kinds, and
    instances not of the base that do not look like the kind or also lie in a contradicting pattern (``min_support``
    instances or more, none of them of the kind).  Other instances not met by the base patterns are no evidence, however many.
    A pattern is trusted from ``min_confidence`` on if ``min_support`` distinct base instances of the kind lie in it; then an
    instance takes the probability that not all of its trusted patterns are wrong, and counts in the next round.

    A pattern around a very common word is one key with many edges: edges are made distinct and summed by partial
    aggregation, and only patterns with enough base instances are joined back.
    """
    each = found.select(F.explode("found").alias("o")).select("o.kind", "o.instance", F.explode("o.patterns").alias("pattern"))
    edges = staged(each.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    based = staged(edges.filter("kind >= 0").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("support")), "pii-based")
    support = staged(based.filter(F.col("support") >= min_support), "pii-support")
    others = based.groupBy("pattern").agg(F.sum("support").alias("known"))
    # instances not of the base in each supported pattern, once for each kind it is supported for
    open_edges = staged(edges.filter("kind < 0").drop("kind").join(support.select("pattern", "kind"), "pattern").withColumn("alike", fits(F.col("instance"), F.col("kind"))), "pii-open")
    # of those that look like the kind, the ones in large patterns that hold none of the kind
    asked = open_edges.filter("alike").select("instance", F.col("kind").alias("asked")).distinct()
    large = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_support).select("pattern")
    around = edges.filter("kind < 0").drop("kind").join(large, "pattern").join(asked, "instance")
    denied = around.join(based.select("pattern", F.col("kind").alias("asked")), ["pattern", "asked"], "left_anti").select("instance", F.col("asked").alias("kind")).distinct()
    open_edges = open_edges.join(denied.withColumn("denied", F.lit(True)), ["instance", "kind"], "left")
    open_edges = staged(open_edges.select("pattern", "instance", "kind", (~F.col("alike") | F.coalesce("denied", F.lit(False))).alias("wrong")), "pii-judged")
    wrong = open_edges.filter("wrong").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("wrong"))
    sizes = support.join(others, "pattern").join(wrong, ["pattern", "kind"], "left")
    sizes = staged(sizes.select("pattern", "kind", "support", (F.col("known") - F.col("support") + F.coalesce("wrong", F.lit(0))).alias("against")), "pii-sizes")

    def trusted(extra: DataFrame | None) -> DataFrame:
        score = sizes.withColumn("extra", F.lit(0.0)) if extra is None else sizes.join(extra, ["pattern", "kind"], "left")
        # what an instance counts for a pattern it no longer counts against it
        held, back = F.col("support") + F.coalesce("extra", F.lit(0.0)), F.coalesce("back", F.lit(0.0)) if extra is not None else F.lit(0.0)
        return score.withColumn("confidence", held / (held + F.col("against") - back + 1)).filter(F.col("confidence") >= min_confidence).select("pattern", "kind", "confidence")

    patterns = staged(trusted(None), "pii-patterns")
    for _ in range(rounds - 1):
        instances = open_edges.join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        extra = open_edges.join(instances, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("extra"), F.sum(F.when(F.col("wrong"), F.col("score"))).alias("back"))
        patterns = staged(trusted(extra), "pii-patterns")
    return patterns


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_support: int = 5, min_confidence: float = 0.8) -> DataFrame:
    """``id, base, spans`` of every row: arrays of ``(start, kind, end)`` in code points, end exclusive.

    ``base`` has the exact matches.  ``spans`` adds candidates that lie in a trusted pattern, with the kind of the most
    trusted one; base matches are never altered.  Null text counts as empty; texts without digits or at signs have no
    spans; repeated rows are scanned each for itself and lend their instances no more weight; ids and other columns may
    hold anything; an empty table gives an empty result.
    """
    found = staged(find(df, id_col, text_col), "pii-found")
    patterns = bootstrap(found, rounds, min_support, min_confidence)
    loose = found.select("row_no", F.explode(F.filter("found", lambda o: o.kind < 0)).alias("o")).select("row_no", "o.start", "o.end", F.explode("o.patterns").alias("pattern"))
    added = (
        loose.join(patterns, "pattern").groupBy("row_no", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
        .groupBy("row_no").agg(F.collect_list(F.struct(F.col("start"), F.col("best.kind").alias("kind"), F.col("end"))).alias("added"))
    )
    triple = lambda o: F.struct(o["start"].alias("start"), o["kind"].alias("kind"), o["end"].alias("end"))
    base = F.transform(F.filter("found", lambda o: o.kind >= 0), triple)
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    return found.select("id", "row_no", base.alias("base")).join(added, "row_no", "left").select("id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")

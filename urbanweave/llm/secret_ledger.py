"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. The ledger holds, per blob,
which rules (with their versions) have read it and what they found. A scan reads
only blobs for which some rule version is not in the ledger, and only with those
rules; findings are then joined back to every path that holds the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.common import bind, in_chunks
from urbanweave.runtime import settle_counted, shared_folder, small_side


@dataclass(frozen=True)
class SecretRule:
    """A pattern, the lower-case strings without which it cannot match, and the length a part must have."""

    kind: str
    pattern: str
    gates: tuple[str, ...] = ()
    group: int = 0
    shortest: int = 1
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in their listed order. A run of 24 and more hex digits is
# what is left of the maximal runs once shorter ones are dropped.
BASE_RULES = [
    SecretRule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        group=2,
        shortest=6,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", ("akia",), shortest=20),
    SecretRule("hex", r"[0-9a-f]{24,}"),
]
# A private key runs to its END line, whatever stands between save five dashes. Where there is none, it
# runs over the header fields and the base64 lines that follow (16 characters and more; quotes, escaped
# line ends and indents between them), with a shorter last one. These lines are counted in bounded
# groups (300 in all, twice a 8,192-bit key): an unbounded group recurses per line in Java.
_DASHES = "-----"
_BASE64 = "[A-Za-z0-9+/=]"
_GAP = r"""[\x20\t\r\n\\"',>#*|+]"""
_LINE = f"{_GAP}*(?:[nr]{_GAP}+){{0,2}}{_BASE64}{{16,}}"
_FIELDS = r"(?:(?:[\r\n]+[\x20\t]*|(?:\\[nr]){1,4})[A-Z][A-Za-z0-9-]{0,30}: [^\r\n]*){0,6}"
_KEY_TO_END = rf"[^-]*(?:-{{1,4}}[^-]+){{0,60}}{_DASHES}END [A-Z ]{{0,20}}PRIVATE KEY{_DASHES}"
_LAST = f"{_GAP}*(?:[nr]{_GAP}+){{0,2}}{_BASE64}{{1,15}}" + r"""(?:["'\\\r\n]|\z)"""
_KEY_LINES = f"{_FIELDS}(?:(?:{_LINE}){{1,60}}{f'(?:{_LINE}){{0,60}}' * 4}(?:{_LAST})?)?"
MORE_RULES = [
    SecretRule("private_key", f"{_DASHES}BEGIN [A-Z ]{{0,20}}PRIVATE KEY{_DASHES}(?:{_KEY_TO_END}|{_KEY_LINES})", ("private key-----",), version=2),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}", ("aiza",)),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
]
RULES = BASE_RULES + MORE_RULES
_SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _matches(text: Column, rule: SecretRule, place: int) -> Column:
    """Spans of a rule, from the texts between its matches and the matches themselves."""
    pattern = F.lit(rule.pattern)
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    judged = hits if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.zip_with(
        F.slice(gaps, 1, F.size(hits)),
        F.arrays_zip(hits.alias("hit"), judged.alias("judged")),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["hit"]).alias("hit"), F.length(m["judged"]).alias("judged")),
    )

    def step(seen: Column, piece: Column) -> Column:
        start = seen["at"] + piece["gap"]
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), (start + piece["hit"]).alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(piece["judged"] >= rule.shortest, F.concat(seen["spans"], F.array(span).cast(_SPANS))).otherwise(seen["spans"])
        return F.struct((start + piece["hit"]).alias("at"), kept.alias("spans"))

    def advance(at: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, at, lambda seen, piece: seen + piece["gap"] + piece["hit"])

    def work(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), _none().alias("spans")), step, lambda seen: seen["spans"])

    return F.flatten(in_chunks(pieces, F.lit(0), advance, work))


def _found(rules: list[SecretRule], missing: Column) -> Column:
    """Sorted spans of the rules still missing, over the columns ``text`` and ``low``."""
    parts = []
    for place, rule in enumerate(rules):
        may = F.array_contains(missing, rule.id)
        if rule.gates:
            gate = F.contains("low", F.lit(rule.gates[0]))
            for other in rule.gates[1:]:
                gate = gate | F.contains("low", F.lit(other))
            may = may & gate
        else:
            may = may & F.col("text").rlike(rule.pattern)
        parts.append(F.when(may, _matches(F.col("text"), rule, place)).otherwise(_none()))
    return F.array_sort(F.concat(*parts))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: list[SecretRule] | None = None, content: str = "text", folder: str | None = None):
    """Scan what the ledger does not know; returns (addresses, ledger).

    ``addresses`` are the rows of ``versions`` without the content but with
    ``blob``; the ledger has blob, rules and spans (start, place of the rule, end,
    kind; code points, end exclusive), and new rows are written to a table in
    ``folder`` (a new one in the shared folder if unset). A null content is an
    empty text. Repeated contents are one blob, whatever their path; repeated
    rows of ``versions`` stay rows. A column ``blob`` of ``versions`` is replaced.
    """
    rules = RULES if rules is None else rules
    spark = versions.sparkSession
    addressed = versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(content), F.lit("")), 256)))
    addresses = addressed.drop(content)
    wanted = F.array(*[F.lit(rule.id) for rule in rules]).cast("array<string>")
    text = F.first(F.coalesce(F.col(content), F.lit(""))).alias("text")
    if ledger is None:
        todo = addressed.groupBy("blob").agg(text).withColumn("missing", wanted)
    else:
        # Hashes meet the ledger first; only texts of blobs that it does not know are moved.
        done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        missing = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        asked = addresses.select("blob").distinct().join(done, "blob", "left").select("blob", missing.alias("missing"))
        asked, rows = settle_counted(asked.where(F.size("missing") > 0))
        unseen = addressed.join(small_side(asked.select("blob"), rows), "blob", "left_semi").groupBy("blob").agg(text)
        todo = unseen.join(small_side(asked, rows), "blob")
    read = todo.select("blob", "text", "missing", F.lower("text").alias("low"))
    fresh = read.select("blob", F.col("missing").alias("rules"), _found(rules, F.col("missing")).alias("spans"))
    path = folder or f"{shared_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    fresh.write.mode("append").parquet(path)
    written = spark.read.schema(fresh.schema).parquet(path)
    return addresses, written if ledger is None or folder else ledger.unionByName(written)


def findings(addresses: DataFrame, ledger: DataFrame, rules: list[SecretRule] | None = None) -> DataFrame:
    """Rows of ``addresses`` with ``spans`` (in place of any such column): what the current rule versions found in their blob."""
    rules = RULES if rules is None else rules
    current = F.array(*[F.lit(rule.id) for rule in rules]).cast("array<string>")
    # Each (blob, rule version) was scanned once, so a row's spans count where its rules do.
    rows = ledger.where(F.arrays_overlap("rules", current))
    ours = rows.withColumn("spans", F.filter("spans", lambda s: _is_current(s["kind"], rules, F.col("rules"))))
    known = ours.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return addresses.drop("spans").join(known, "blob", "left").withColumn("spans", F.coalesce("spans", _none()))


def _is_current(kind: Column, rules: list[SecretRule], scanned: Column) -> Column:
    verdict = F.lit(False)
    for rule in rules:
        verdict = verdict | ((kind == rule.kind) & F.array_contains(scanned, rule.id))
    return verdict


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_text(spans: Column, kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined, by start and then rule order."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones united, replaced by ``mark``.

    The text is cut once for each chunk of spans, and the part of a chunk once for each span.
    """

    def advance(at: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, at, lambda seen, span: F.greatest(seen, span["end"]))

    def work(chunk: Column, base: Column) -> Column:
        def parts(own: Column) -> Column:
            def step(seen: Column, span: Column) -> Column:
                gap = F.substring(own, seen["at"] - base + 1, span["start"] - seen["at"])
                fresh = span["start"] >= seen["at"]
                return F.struct(
                    F.greatest(seen["at"], span["end"]).alias("at"),
                    F.when(fresh, F.concat(seen["out"], F.array(gap, F.lit(mark)))).otherwise(seen["out"]).alias("out"),
                )

            first = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))
            return F.array_join(F.aggregate(chunk, first, step, lambda seen: seen["out"]), "")

        return bind(F.substring(text, base + 1, advance(base, chunk) - base), parts)

    marked = F.array_join(in_chunks(spans, F.lit(0), advance, work), "")
    tail = F.substring(text, advance(F.lit(0), spans) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(marked, tail)).otherwise(text)


def redact_all(docs: DataFrame, rules: list[SecretRule] | None = None, size: str | None = "n_chars") -> DataFrame:
    """Rows of ``docs``, all columns, with every span found in ``text`` replaced, and ``size`` brought up to date.

    Only blobs with findings are joined back; they are broadcast when counted few.
    """
    columns = docs.columns
    _, ledger = scan(docs.select("text"), rules=rules)
    found, rows = settle_counted(ledger.where(F.size("spans") > 0).select("blob", "spans"))
    blob = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    joined = docs.join(small_side(found, rows), blob == found["blob"], "left")
    hit = found["blob"].isNotNull()
    text = F.when(hit, redact(docs["text"], found["spans"])).otherwise(docs["text"])
    new = {"text": text.alias("text")}
    if size in columns:
        new[size] = F.when(hit, F.length(text)).otherwise(docs[size]).cast(docs.schema[size].dataType).alias(size)
    return joined.select(*[new.get(c, docs[c]) for c in columns])

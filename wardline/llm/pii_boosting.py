"""Personal data by boosted trees over candidate spans, in built-in functions throughout.

Generators propose spans: strict patterns for e-mail addresses, IPv4 addresses, card and
phone numbers, and loose ones (written-out addresses, IPv6 addresses, any longer
number). Strict spans that pass their check (octets, Luhn, number of digits) always stay.
Loose spans are scored by boosted trees on their format and their surroundings, and stay
from a threshold per kind, if nothing better overlaps them.

The trees learn from all strict spans of the corpus, good ones against those that fail
their check, and from a short list of examples. Spark sums the rows per distinct feature
vector, and only these sums reach the driver. One fifth of the documents, and every
second example, are kept apart; the loose spans among them calibrate the thresholds.

Cases: a null text is empty; rows that share id and text have the same spans; an empty
table gives an empty result, and the trees then know the examples alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.boosting import Leaf, Node, Pattern, boosted, margin, margin_column
from wardline.llm.common import staged, text_hash

KINDS = ("email", "ip", "card", "phone")
#: Generators: name, whether strict, pattern. Runs are possessive and start only where a
#: run starts, so a long run is read once.
GENERATORS = (
    ("email", True, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", True, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    (
        "email_written", False,
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:[(\[{<](?:at|AT|@)[)\]}>]|@)(?: ?[A-Za-z0-9-]{1,63}+"
        r"(?: ?(?:[(\[{<](?:dot|DOT|\.)[)\]}>]| dot |\.) ?[A-Za-z0-9-]{2,63}+){1,4}+)",
    ),
    ("ip_long", False, r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+::?){2,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])"),
    ("number", False, r"(?<![0-9])\(?[0-9](?:[ ().\-/]{0,2}+[0-9]){6,18}+(?![0-9])"),
)
#: Characters before a span that are looked at.
CONTEXT = 28
THRESHOLD, PRECISION = 0.5, 0.9
FEATURES = ["f_generator", "f_check", "f_digits", "f_separators", "f_groups", "f_cue", "f_against", "f_before", "f_after"]

CUES = {
    "email": r"(?i)(mail|contact|correo|courriel|kontakt|write to|escrib|schreib)[^0-9]*$",
    "ip": r"(?i)(\bip\b|ipv[46]|address|host|server|login|adresse|direcci)[^0-9]*$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|tarjeta|karte|carte)[^0-9]*$",
    "phone": r"(?i)(phone|\btel\b|\btel\.|telef|téléph|call|fax|mobil|cell|móvil|whatsapp|llam|anruf|appel)[^0-9]*$",
}
AGAINST = (
    r"(?i)(order|invoice|isbn|issn|version|\bv|page|token|password|\bid\b|ref|date|build|serial|total|population|year|"
    r"\bno\.|article|section|chapter|time|score|\$|€|£|#|=)[^0-9A-Za-z]*$"
)

#: Worked examples: 1 is personal data.
EXAMPLES = (
    (1, "call me on (555) 201-3344 today"), (1, "phone: 555-201-3344"), (1, "Tel. 030 1234 5678 please"),
    (1, "my mobile 0171 2345678 is on"), (1, "fax 01 44 55 66 77"), (1, "reach us at 212-555-0188, thanks"),
    (1, "or call 415.555.0132 now"), (1, "telefon 089/123456-78"), (1, "whatsapp 600 123 456"), (1, "cell (703) 555 0148"),
    (1, "ring 617-555-0199"), (1, "(206) 555-0121"), (1, "card 3782 822463 10005 exp"), (1, "visa 4222222222222"),
    (1, "amex 378282246310005 on file"), (1, "credit card 3056 9309 0259 04"), (1, "write to jane.doe [at] mail [dot] example [dot] com"),
    (1, "mail: bob(at)example.org"), (1, "contact amy {at} post.example.net"), (1, "kim [at] example.com"), (1, "joe (AT) example (DOT) com"),
    (1, "host 2001:db8:85a3:0:0:8a2e:370:7334 up"), (1, "from fe80:0:0:0:200:f8ff:fe21:67cf"), (1, "ip 2001:db8::ff00:42:8329"),
    (0, "order 20431187 shipped"), (0, "invoice 2023-001-4471"), (0, "isbn 978-3-16-148410-0"), (0, "on 2024-03-01 10 of them"),
    (0, "from 1999-2004 1 2 3"), (0, "version 10.2.33.1204.5"), (0, "population 83 200 000"), (0, "id 4711000123"),
    (0, "token 83920175563012"), (0, "build 20240301.1200"), (0, "total 1.234.567.890"), (0, "at 12:30:45 we left"),
    (0, "score 3:2:1"), (0, "pages 101-2234567"), (0, "chapter 1.2.3.4.5.6.7.8"), (0, "time 23:59:59"), (0, "0 1 2 3 4 5 6 7 8 9"),
    (0, "serial 00000000000000"), (0, "date 01/02/2023 04/05/2023"), (0, "pi is 3.14159265358979"), (0, "ref 123456-789-123"),
    (0, "mac 00:1b:44:11:3a:b7 seen"), (0, "ratio 1:2:3:4"), (0, "abc@ see. more"), (0, "mail @ the. office"),
)


_TURNS = "array<struct<generator:int,turn:int,hit:string,gap:struct<length:int,before:string,first:string>>>"


def _proposed(number: int) -> Column:
    """The hits of one generator, each after the gap before it; the last gap has no hit."""
    name, _, pattern = GENERATORS[number]
    hits = F.regexp_extract_all("text", F.lit(pattern), 0)
    gaps = F.transform(
        F.split("text", pattern, -1),
        lambda g: F.struct(F.length(g).alias("length"), F.right(g, F.lit(CONTEXT)).alias("before"), F.left(g, F.lit(1)).alias("first")),
    )
    turns = F.transform(
        F.arrays_zip(hits.alias("hit"), gaps.alias("gap")),
        lambda x, i: F.struct(F.lit(number).alias("generator"), i.alias("turn"), x["hit"].alias("hit"), x["gap"].alias("gap")),
    )
    # a cheap test first: most texts hold none of it
    may = {"email": F.col("text").contains("@"), "email_written": F.col("text").rlike(r"@|[(\[{<](at|AT)[)\]}>]")}.get(name, F.col("has_digit"))
    return F.when(may & F.col("text").rlike(pattern), turns).otherwise(F.array().cast(_TURNS))


def _spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every proposed span of ``text``: ``keys, generator, start, end, hit, before, after``.

    A pattern's hits and the gaps between them, in turn, make up the text, so a running
    sum of their lengths gives the places.
    """
    found = rows.where("text is not null").withColumn("has_digit", F.col("text").rlike("[0-9]"))
    every = F.concat(*(_proposed(number) for number in range(len(GENERATORS))))
    found = found.select(*keys, F.inline(every)).dropDuplicates([*keys, "generator", "turn"])
    turns = Window.partitionBy(*keys, "generator").orderBy("turn")
    length = F.col("gap.length") + F.coalesce(F.length("hit"), F.lit(0))
    placed = found.withColumns(
        {
            "end": F.sum(length).over(turns.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "after": F.lead("gap.first").over(turns),
        }
    )
    return placed.where("hit is not null").select(
        *keys, "generator", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", F.col("gap.before").alias("before"), "after"
    )


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _scored(spans: DataFrame) -> DataFrame:
    """``spans`` with the kind, ``strict``, whether the check is passed, and the features."""
    digits = F.regexp_replace("hit", "[^0-9]", "")
    n = F.length("digits")
    octets = F.forall(
        F.split("hit", r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.right(x, F.lit(3)).cast("int"), F.lit(0)) <= 255)
    )
    luhn = F.when((n >= 13) & (n <= 19), _luhn(F.col("digits"))).otherwise(False)
    names = F.array(*(F.lit(name) for name, _, _ in GENERATORS))
    strict = F.array(*(F.lit(s) for _, s, _ in GENERATORS))
    spans = spans.withColumns({"digits": digits, "name": names[F.col("generator")], "strict": strict[F.col("generator")]}).withColumn("luhn", luhn)
    check = (
        F.when(F.col("name") == "ip", octets)
        .when(F.col("name") == "card", (n >= 16) & F.col("luhn"))
        .when(F.col("name") == "phone", (n >= 8) & (n <= 15))
        .when(F.col("name") == "number", F.col("luhn"))
        .when(F.col("name") == "ip_long", F.size(F.split("hit", ":")) == 8)
        .otherwise(True)
    )
    kind = (
        F.when(F.col("name") == "number", F.when(F.col("luhn"), "card").otherwise("phone"))
        .when(F.col("name") == "ip_long", "ip")
        .when(F.col("name") == "email_written", "email")
        .otherwise(F.col("name"))
    )
    spans = spans.withColumns({"passed": check, "kind": kind})
    separators = F.regexp_replace("hit", "[0-9A-Za-z]", "")
    cue = F.lit(False)
    for name, pattern in CUES.items():
        cue = cue | ((F.col("kind") == name) & F.col("before").rlike(pattern))
    style = (
        F.when(separators == "", 0).when(separators.rlike(r"^ +$"), 1).when(separators.rlike("^-+$"), 2)
        .when(separators.rlike(r"^\.+$"), 3).when(separators.rlike(r"^[:]+$"), 4).when(separators.rlike(r"[(\[{<+]"), 6).otherwise(5)
    )
    groups = F.size(F.split("hit", "[^0-9A-Za-z]+"))
    return spans.withColumns(
        {
            "f_generator": F.col("generator"),
            "f_check": F.col("passed").cast("int"),
            "f_digits": F.when(n < 7, 0).when(n < 9, 1).when(n < 10, 2).when(n < 12, 3).when(n < 13, 4).when(n < 16, 5).when(n < 20, 6).otherwise(7),
            "f_separators": style,
            "f_groups": F.least(groups, F.lit(9)),
            "f_cue": cue.cast("int"),
            "f_against": F.col("before").rlike(AGAINST).cast("int"),
            "f_before": F.when(F.col("before").rlike("[0-9A-Za-z]$"), 1).when(F.col("before").rlike(r"[.,:/+-]$"), 2).otherwise(0),
            "f_after": F.when(F.col("after").rlike("[0-9A-Za-z@]"), 1).otherwise(0),
        }
    )


def _patterns(counts: list, apart: bool) -> list[Pattern]:
    """Rows of one half as patterns; a pattern that is seen often counts by its logarithm."""
    sums: dict[tuple, list[float]] = {}
    for row in counts:
        if bool(row.apart) == apart:
            weight = 1 + math.log(row.n)
            sums.setdefault(tuple(int(row[f]) for f in FEATURES), [0.0, 0.0])[int(row.y)] += weight
    return [Pattern(key, *w) for key, w in sorted(sums.items())]


def learned(strict: DataFrame) -> tuple[list[Node | Leaf], dict[str, float]]:
    """The trees and the threshold of each kind, in log odds.

    ``strict`` has the scored strict spans. What reaches the driver is one row per
    distinct feature vector, half and class; the features have few values each.
    """
    spark = strict.sparkSession
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("doc"), F.lit(y).alias("y"), F.lit(t).alias("text")) for i, (y, t) in enumerate(EXAMPLES))))
    texts = spark.range(1).select(listed.alias("x")).select("x.*")
    # an example stands for the longest span that is proposed in it
    spans = _scored(_spans(texts.select("doc", "text"), ["doc"])).where("not strict")
    spans = spans.join(texts.select("doc", "y"), "doc").select(*FEATURES, F.col("doc") % 2 == 1, "y")
    corpus = strict.select(*FEATURES, F.col("fold") == 0, F.col("passed").cast("int"))
    columns = [*FEATURES, "apart", "y"]
    counts = corpus.toDF(*columns).unionByName(spans.toDF(*columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()
    trees = boosted(_patterns(counts, False))
    return trees, _thresholds(trees, _patterns(counts, True))


def _thresholds(trees: list[Node | Leaf], apart: list[Pattern]) -> dict[str, float]:
    """The threshold of each kind from its loose spans alone; strict ones need none and would outweigh them."""
    kind_of = {4: "email", 5: "ip"}
    loose = [(margin(trees, p.features), p) for p in apart if not GENERATORS[p.features[0]][1]]
    kinds = [kind_of.get(p.features[0], "card" if p.features[1] else "phone") for _, p in loose]
    return {kind: _threshold([row for row, k in zip(loose, kinds, strict=True) if k == kind]) for kind in KINDS}


def _threshold(rows: list[tuple[float, Pattern]]) -> float:
    """The lowest margin from which the rows kept apart are precise enough; never below even odds."""
    lowest = math.log(THRESHOLD / (1 - THRESHOLD))
    best, good, bad = None, 0.0, 0.0
    for z, p in sorted(rows, key=lambda r: -r[0]):
        good, bad = good + p.positive, bad + p.negative
        if good >= PRECISION * (good + bad):
            best = z
    worst = max((z for z, p in rows if p.negative), default=lowest)
    if best is None:
        return max(lowest, worst + 1e-9)
    return max(lowest, best)


def pii_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(spans, keyed)``: the chosen spans by ``doc_id`` and ``__llm_own``, and all documents' keys.

    A span has ``kind, start, end, base``; ``start`` and ``end`` count code points.
    """
    keys = ["doc_id", "__llm_own"]
    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("__llm_own"), "text")
    scored = _scored(_spans(keyed, keys)).withColumn("fold", F.pmod(F.xxhash64(*keys), F.lit(5)))
    scored = staged(scored.select(*keys, "kind", "start", "end", "strict", "passed", "fold", *FEATURES), "pii-candidates")
    trees, thresholds = learned(scored.where("strict"))
    base = scored.where("strict and passed").select(*keys, "kind", "start", "end", F.lit(True).alias("base"), F.lit(1e9).alias("odds"))
    limits = F.create_map(*(F.lit(x) for pair in thresholds.items() for x in pair))
    loose = scored.where("not strict").withColumn("odds", margin_column(trees, FEATURES)).where(F.col("odds") >= limits[F.col("kind")])
    loose = loose.select(*keys, "kind", "start", "end", F.lit(False).alias("base"), "odds").dropDuplicates([*keys, "kind", "start", "end"])
    listed = base.unionByName(loose).groupBy(*keys)
    listed = listed.agg(F.collect_list(F.struct("kind", "start", "end", "base", "odds")).alias("spans"))

    def beaten(x: Column, y: Column) -> Column:
        meets = (y["start"] < x["end"]) & (x["start"] < y["end"])
        better = (y["odds"] > x["odds"]) | ((y["odds"] == x["odds"]) & ((y["start"] < x["start"]) | ((y["start"] == x["start"]) & (y["end"] > x["end"]))))
        return meets & better

    added = F.filter("spans", lambda x: ~x["base"])
    chosen = F.filter(added, lambda x: ~F.exists("spans", lambda y: beaten(x, y)))
    merged = F.concat(F.filter("spans", lambda x: x["base"]), chosen)
    spans = listed.select(*keys, F.explode(merged).alias("x")).select(*keys, "x.kind", "x.start", "x.end", "x.base")
    return spans, keyed


def pii(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every document."""
    spans, keyed = pii_spans(docs)
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    entry = F.struct(rank.alias("rank"), "start", "end", "kind", "base")
    lists = spans.groupBy("doc_id", "__llm_own").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    lists = staged(lists, "pii-lists").withColumnsRenamed({"doc_id": "__llm_id", "__llm_own": "__llm_hash"})
    narrow = keyed.select("doc_id", "__llm_own")
    joined = narrow.join(lists, narrow["doc_id"].eqNullSafe(F.col("__llm_id")) & (F.col("__llm_own") == F.col("__llm_hash")), "left")
    found = F.coalesce("found", F.array().cast(lists.schema["found"].dataType))
    base = F.filter("found", lambda x: x["base"])

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return joined.select("doc_id", found.alias("found")).select(
        "doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans")
    )

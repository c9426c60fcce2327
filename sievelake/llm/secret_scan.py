"""Secret scans: fixed patterns, and strings that look random under character Markov models.

Everything is DataFrame functions inside one scan; nothing is shuffled but the counts of the model's
training. Matches are marked in the text by characters that are not in it, and their places follow from
the lengths between the marks. Two first-order Markov models, of random strings and of ordinary
identifiers, are counted on labelled samples; a token is reported when the log-likelihood ratio per
character is above a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, kept

KINDS = ("assign", "access", "hex", "random")

#: The base patterns. The first one's second group is the secret itself.
ASSIGN = (
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
)
#: Of the others a match is a whole run, so that asking for its least length in the pattern gives the same.
#: A run starts where no character of it stands before, so that nothing is tried inside a short one.
ACCESS = r"()(AKIA[A-Z0-9]{12,})"
HEX = r"()((?<![0-9a-f])[0-9a-f]{32,})"
LEAST = (8, 16, 32)

#: Tokens that the models compare.
TOKEN = r"()((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,})"
LEAST_TOKEN = 20

#: A token is reported when its mean log-likelihood ratio per character is above this.
THRESHOLD = 0.5

#: The documented bound of the labelled sample: so many documents of each label.
SAMPLE_ROWS = 4000

#: Characters of tokens, in the order of the model's tables.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"

_OPEN, _SHUT, _OTHER = chr(0xE000), chr(0xE001), chr(0xE002)


def _unmarked(text: Column) -> Column:
    """The text with the marking characters, which no pattern matches, replaced by another such character."""
    held = text.contains(_OPEN) | text.contains(_SHUT)  # hardly any: replacing costs more than looking
    return F.when(held, F.translate(text, _OPEN + _SHUT, _OTHER + _OTHER)).otherwise(F.coalesce(text, F.lit("")))


def parts_of(text: Column, pattern: str) -> Column:
    """The text cut before each match of a pattern, whose two groups make up the match; marks end both groups.

    Store it in a column before ``matches`` reads it several times; ``text`` holds no marks.
    """
    return F.split(F.regexp_replace(text, pattern, f"{_OPEN}$1{_SHUT}$2{_SHUT}"), _OPEN, -1)


def matches(parts: Column, least: int) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    Those whose second group is shorter than ``least`` are dropped after matching.
    """
    found = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, _SHUT, 3))
    sized = F.transform(
        found,
        lambda m: F.struct(
            (F.length(m[0]) + F.length(m[1])).alias("size"), F.length(m[2]).alias("gap"), m[1].alias("value")
        ),
    )
    start = F.struct(
        F.length(parts[0]).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found")
    )

    def step(acc, m):
        end = acc["at"] + m["size"]
        here = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), m["value"].alias("value")))
        keep = F.length(m["value"]) >= least
        return F.struct(
            (end + m["gap"]).alias("at"),
            F.when(keep, F.concat(acc["found"], here)).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(sized, start, step, lambda acc: acc["found"])


def with_matches(rows: DataFrame, text: str) -> DataFrame:
    """Add _m0, _m1 and _m2, the base matches by kind, and _tokens, the matches of TOKEN."""
    patterns = (ASSIGN, ACCESS, HEX, TOKEN)
    cut = rows.withColumns({f"_parts{k}": parts_of(F.col(text), pattern) for k, pattern in enumerate(patterns)})
    found = zip(("_m0", "_m1", "_m2", "_tokens"), (*LEAST, LEAST_TOKEN))
    columns = {name: matches(F.col(f"_parts{k}"), least) for k, (name, least) in enumerate(found)}
    return cut.withColumns(columns).drop(*[f"_parts{k}" for k in range(len(patterns))])


def _pairs(tokens: DataFrame) -> DataFrame:
    """(pair, n): neighbouring characters of the tokens in column ``token``."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2))))
    return tokens.where(F.length("token") > 1).select(pair.alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(token, random): values that the base patterns find, and words of texts where they find nothing.

    About ``rows`` documents of each label, chosen by a hash of their id.
    """
    text = _unmarked(F.col("text"))
    hint = F.col("text").rlike(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    rows_of = docs.select("doc_id", text.alias("text"), F.coalesce(hint, F.lit(False)).alias("hint"))
    secrets = bounded_sample(rows_of.where("hint"), rows)
    found = [F.transform(m, lambda x: x["value"]) for m in ("_m1", "_m2")]
    secrets = with_matches(secrets, "text").select(F.explode(F.concat(*found)).alias("token"), F.lit(True).alias("random"))
    plain = bounded_sample(rows_of.where("NOT hint"), rows)
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([A-Za-z_]{3,})"), 1)
    return secrets.unionByName(plain.select(F.explode(words).alias("token"), F.lit(False).alias("random")))


def log_ratios(sample: DataFrame) -> list[float]:
    """For each pair of alphabet characters log p(second | first, random) - log p(second | first, plain).

    Counts are smoothed towards how often the label has the second character at all, and that towards
    all characters alike. At most 66 x 66 counts of each label come to the driver.
    """
    import math

    size = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = {label: [[0.0] * size for _ in range(size)] for label in (True, False)}
    for label in (True, False):
        pairs = _pairs(sample.where(F.col("random") == label)).where(F.col("pair").rlike(f"^[{ALPHABET}]{{2}}$"))
        for pair, n in pairs.collect():
            counts[label][place[pair[0]]][place[pair[1]]] += n

    def logs(table):
        total = sum(map(sum, table))
        share = [(sum(row[b] for row in table) + 1) / (total + size) for b in range(size)]
        return [math.log((n + size * p) / (sum(row) + size)) for row in table for n, p in zip(row, share)]

    return [round(a - b, 4) for a, b in zip(logs(counts[True]), logs(counts[False]))]


def random_matches(found: Column, ratios: Column, base: Column, threshold: float) -> Column:
    """Tokens above the threshold that touch no base match."""
    size = len(ALPHABET)

    def ratio(token):
        def step(acc, c):
            place = F.instr(F.lit(ALPHABET), c)
            added = F.when(acc["last"] > 0, F.get(ratios, (acc["last"] - 1) * size + place - 1)).otherwise(F.lit(0.0))
            return F.struct(place.alias("last"), (acc["total"] + added).alias("total"))

        start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("total"))
        return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["total"] / (F.length(token) - 1))

    mixed = F.filter(found, lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    apart = F.filter(mixed, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.filter(apart, lambda m: ratio(m["value"]) > threshold)


def scan(docs: DataFrame, ratios: list[float], carry=("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns, n_assign, n_access, n_hex, base_sha256, spans, and found (array of kind, start, end).

    Null texts are empty and have no match. Positions are code points, ends exclusive; spans are sorted by
    start, then kind in the order of KINDS. Equal rows each give their result; carried columns named like
    a result are left out.
    """
    results = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")
    carry = [c for c in carry if c not in results]
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], _unmarked(F.col("text")).alias("_text"))
    rows = with_matches(rows, "_text").drop("_text")
    table = F.array(*map(F.lit, ratios))
    rows = rows.withColumn("_m3", random_matches(F.col("_tokens"), table, F.concat("_m0", "_m1", "_m2"), threshold))

    def spans(kinds):
        def of(kind):
            return F.transform(f"_m{kind}", lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

        return F.array_sort(F.concat(*map(of, kinds)))

    def joined(found):
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    names = F.array(*map(F.lit, KINDS))
    return rows.select(
        *[F.col(f"`{c}`") for c in carry],
        *[F.size(f"_m{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(spans(range(3))).cast("binary"), 256).alias("base_sha256"),
        joined(spans(range(4))).alias("spans"),
        F.transform(
            spans(range(4)), lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        ).alias("found"),
    )


def redacted(text: Column, found: Column, by: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced; spans are sorted by start."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(new, F.concat(acc["out"], before, F.lit(by))).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, rest))


def clean(docs: DataFrame) -> DataFrame:
    """All documents with their secrets replaced in text, and n_chars where there is one counted anew."""
    ratios = log_ratios(kept(labelled_sample(docs), "tokens"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    found = scan(rows.withColumn("_text_as_read", F.col("text")), ratios, carry=("_row",))
    text = F.when(F.size("found") > 0, redacted(F.col("_row.text"), F.col("found"))).otherwise(F.col("_row.text"))
    found = found.withColumn("_new", text)
    columns = []
    for c in docs.columns:
        old = F.col(f"_row.`{c}`")
        if c == "text":
            old = F.col("_new")
        elif c == "n_chars":
            old = F.when(F.size("found") > 0, F.length("_new").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return found.select(*columns)

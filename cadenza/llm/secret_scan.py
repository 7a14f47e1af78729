"""Secrets in text: fixed patterns, and tokens that a battery of randomness tests finds too even for text.

Every candidate token gets an encoding (hex, base32 or base36 in either case, or base64) from the characters it uses, and
three tests that tell a random string of that encoding from a plain one, such as an identifier, a path or a run of words:

* chi-squared, as the number of equal pairs of characters over what a uniform use of the alphabet gives;
* runs of one character class (upper case, lower case, digit, other), which are short where characters are drawn at random;
* serial correlation of vowels and consonants in neighbouring letters, which alternate in words.

Each gives a standard score against plain tokens, whose means and spreads are fixed parameters (`PLAIN`, measured on
names, paths and joined words). The scores are added, their correlation allowed for, to one p-value: the chance that a plain
token looks so random. All candidates of the table are one family. p-values are divided by the token's share of the mean
length, as longer tokens carry more evidence, and the Benjamini-Hochberg step over them keeps the share of plain tokens
among those reported at `rate`. Last, a token that is too regular to be random (an alphabet in order, strict alternation) is
left out, by the same statistics and the serial correlation of places in the alphabet.

Only DataFrame functions are used. Spans are found inside a row, without a shuffle; the family is summed up in one
aggregation to some thousand rows at most, whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans of the second pattern group must be that long for an assignment, of the whole match for the others.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))
#: The same matches that are long enough; shorter ones are dropped anyway and don't move the others.
_HEX_RUN = r"(?<![0-9a-f])[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: The part of reported random tokens that may be plain.
RATE = 0.01
#: What plain tokens of one case, and of both, look like: mean and spread (over the root of the length) of equal pairs by those of chance, and of changes of class by pairs of neighbours.
PLAIN = {"one": (1.8, 3.0, 0.12, 0.26), "both": (2.9, 5.0, 0.38, 0.40)}
#: Changes between vowel and consonant by pairs of neighbouring letters, in plain tokens.
ALTERNATE = 0.65
#: The spread of the three scores' sum in plain tokens; it would be the root of 3 if they were independent.
SPREAD = 2.0
#: Standard deviations from what is random at which a token is too regular.
REGULAR = 3.3
#: name, what all its characters match, what it must contain, alphabet, kind of plain token, chance that neighbours differ in class
ENCODINGS = (
    ("hex", "[0-9a-f]+", ("[0-9]", "[a-f]"), "0123456789abcdef", "one", 0.469),
    ("upper hex", "[0-9A-F]+", ("[0-9]", "[A-F]"), "0123456789ABCDEF", "one", 0.469),
    ("base32", "[A-Z2-7]+", ("[A-Z]", "[2-7]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "one", 0.305),
    ("lower base32", "[a-z2-7]+", ("[a-z]", "[2-7]"), "abcdefghijklmnopqrstuvwxyz234567", "one", 0.305),
    ("upper base36", "[A-Z0-9]+", ("[A-Z]", "[0-9]"), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "one", 0.401),
    ("lower base36", "[a-z0-9]+", ("[a-z]", "[0-9]"), "0123456789abcdefghijklmnopqrstuvwxyz", "one", 0.401),
    ("base64", "[A-Za-z0-9+/]+", ("[A-Z]", "[a-z]", "[0-9]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "both", 0.645),
)
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_CLASSES = "U" * 26 + "L" * 26 + "D" * 10 + "OO"
_SOUNDS = "".join("V" if c in "aeiou" else "C" for c in _LOWER)
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Steps of the logarithm to which p-values are rounded up before they are counted, elements to a block of a running total.
STEPS, BLOCK = 20, 64


def below(z: Column) -> Column:
    """The normal distribution function, to seven digits (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.abs(tail - (z >= 0).cast("int"))


def _blocks(values: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def _running(df: DataFrame, values: str, out: str, step) -> DataFrame:
    """Adds `out`: the running result of step(so far, next), from 0, over an array column of longs that isn't empty; null stays null.

    It is formed in blocks, and the blocks' results in turn, so its cost grows with the length and not with its square.
    """
    last, start = lambda a: F.element_at(a, -1), F.array(F.lit(0).cast("long"))
    df = df.withColumn("_in", F.transform(_blocks(values), lambda b: F.aggregate(b, start, lambda a, v: F.array_append(a, step(last(a), v)))))
    df = df.withColumn("_head", F.aggregate("_in", start, lambda a, b: F.array_append(a, step(last(a), last(b)))))
    whole = F.flatten(F.zip_with("_in", F.slice("_head", F.lit(1), F.size("_in")), lambda b, h: F.transform(F.slice(b, 2, BLOCK), lambda v: step(h, v))))
    return df.withColumn(out, whole).drop("_in", "_head")


def _matches(df: DataFrame, name: str, pattern: str, group: int, text: str = "_t") -> DataFrame:
    """Adds column `name`: spans struct(start, end, said) of the pattern's matches, with the group's text as `said`."""
    df = df.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size("_m") > 0
    df = df.withColumn("_g", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col("_m"))
    df = df.withColumn("_w", F.when(some, F.flatten(F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size("_m")), "_m", lambda s, m: F.array(F.length(s).cast("long"), F.length(m).cast("long"))))))
    df = _running(df, "_w", "_at", lambda a, v: a + v)
    at = lambda i: F.get("_at", i).cast("int")
    spans = F.transform(F.sequence(F.lit(0), F.size("_m") - 1), lambda i: F.struct(at(2 * i).alias("start"), at(2 * i + 1).alias("end"), F.get("_g", i).alias("said")))
    return df.withColumn(name, F.when(some, spans).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,said:string>>)"))).drop("_m", "_g", "_w", "_at")


def _blanked(text: str, pattern: str, group: int, least: int) -> Column:
    """The text with blanks in place of the pattern's matches whose group is long enough."""
    whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    masked = F.zip_with(whole, part, lambda m, g: F.when(F.length(g) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), masked, lambda s, m: F.concat(s, F.coalesce(m, F.lit("")))), "")


def _bare(token: Column) -> Column:
    """One token without padding, in the standard alphabet."""
    return F.struct(token["start"].alias("start"), token["end"].alias("end"), F.translate(F.regexp_replace(token["said"], "=+$", ""), "-_", "+/").alias("said"))


def _encoding(x: Column) -> Column:
    """The encoding of one bare token: struct(start, end, said, code), code null for none."""
    code = F.lit(None).cast("int")
    for i, (_, form, holds, *_) in reversed(list(enumerate(ENCODINGS))):
        code = F.when(x["said"].rlike("^" + "".join(f"(?=.*{h})" for h in holds) + f"{form}$"), i).otherwise(code)
    return F.struct(*(x[c].alias(c) for c in ("start", "end", "said")), code.alias("code"))


def _of(code: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), code + 1)


def _placed(x: Column) -> Column:
    """Of one encoded token: its length, alphabet and parameters, its characters' classes and sounds, and their places in the alphabet. What a lambda refers to may be computed anew for each element, so every step's results are fields before a lambda uses them."""
    alphabet = _of(x["code"], [e[3] for e in ENCODINGS])
    number = lambda i: _of(x["code"], [float(PLAIN[e[4]][i]) for e in ENCODINGS])
    at = F.transform(F.split(x["said"], "(?!^)(?=.)"), lambda c: F.instr(alphabet, c).cast("double"))
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["said"].alias("said"), F.length(x["said"]).cast("double").alias("n"), F.split(alphabet, "(?!^)(?=.)").alias("alphabet"),
        number(0).alias("alike"), number(1).alias("alike_sd"), number(2).alias("change"), number(3).alias("change_sd"), _of(x["code"], [e[5] for e in ENCODINGS]).alias("differ"),
        F.translate(x["said"], _UPPER + _LOWER + _DIGITS + "+/", _CLASSES).alias("classes"), F.translate(F.lower(x["said"]), _LOWER, _SOUNDS).alias("sounds"), at.alias("at"),
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _counted(x: Column) -> Column:
    """Of one placed token: its counts, and the mean of its places."""
    squares = _total(F.transform(x["alphabet"], lambda c: F.pow((x["n"] - F.length(F.replace(x["said"], c, F.lit("")))).cast("double"), F.lit(2.0))))
    count = lambda text, form: F.regexp_count(text, F.lit(form)).cast("double")
    kept = [x[c].alias(c) for c in ("start", "end", "n", "alike", "alike_sd", "change", "change_sd", "differ", "at")]
    return F.struct(
        *kept, F.size(x["alphabet"]).cast("double").alias("k"), ((squares - x["n"]) / 2).alias("pairs"), count(x["classes"], "U(?=[^U])|L(?=[^L])|D(?=[^D])|O(?=[^O])").alias("changes"),
        count(x["sounds"], "[VC](?=[VC])").alias("letters"), count(x["sounds"], "V(?=C)|C(?=V)").alias("turns"), (_total(x["at"]) / x["n"]).alias("centre"),
    )


def _scored(x: Column) -> Column:
    """Of one counted token: struct(start, end, n, z, regular): z is the sum of its three scores against plain tokens by its spread."""
    n, possible = x["n"], x["n"] * (x["n"] - 1) / 2
    chance = possible / x["k"]
    chi = (x["alike"] - x["pairs"] / chance) * F.sqrt(n) / x["alike_sd"]
    runs = (x["changes"] / (n - 1) - x["change"]) * F.sqrt(n) / x["change_sd"]
    serial = F.when(x["letters"] > 0, (ALTERNATE * x["letters"] - x["turns"]) / F.sqrt(ALTERNATE * (1 - ALTERNATE) * x["letters"])).otherwise(0.0)
    size = F.size(x["at"]) - 1
    ahead = _total(F.zip_with(F.slice(x["at"], F.lit(1), size), F.slice(x["at"], F.lit(2), size), lambda a, b: (a - x["centre"]) * (b - x["centre"])))
    spread = _total(F.transform(x["at"], lambda v: (v - x["centre"]) * (v - x["centre"])))
    too_even = (chance - x["pairs"]) / F.sqrt(chance * (1 - 1 / x["k"]))
    too_mixed = (x["changes"] - (n - 1) * x["differ"]) / F.sqrt((n - 1) * x["differ"] * (1 - x["differ"]))
    in_order = F.abs(ahead / F.greatest(spread, F.lit(1e-9)) * F.sqrt(n) + 1 / F.sqrt(n))
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), ((chi + runs + serial) / SPREAD).alias("z"), (F.greatest(too_even, too_mixed, in_order) > REGULAR).alias("regular"))


def _tested(x: Column) -> Column:
    """Of one scored token: struct(start, end, n, p, regular): p is the chance that a plain token looks so random."""
    return F.struct(*(x[c].alias(c) for c in ("start", "end", "n")), F.greatest(below(-x["z"]), F.lit(1e-300)).alias("p"), x["regular"].alias("regular"))


def _assigned(df: DataFrame) -> DataFrame:
    df = _matches(df, "_assign", ASSIGN, 2)
    return df.withColumn("_assign", F.filter("_assign", lambda x: F.length(x["said"]) >= PATTERNS[0][3]))


def _candidates(df: DataFrame) -> DataFrame:
    """Adds _tested: the candidate tokens outside of base spans, with their p-values. Needs _t and _assign."""
    df = df.withColumn("_rest", F.when(F.size("_assign") > 0, _blanked("_t", *PATTERNS[0][1:])).otherwise(F.col("_t")))
    df = _matches(df, "_tokens", TOKEN, 0, "_rest")
    apart = F.filter("_tokens", lambda x: ~x["said"].rlike("AKIA[A-Z0-9]{14}|[0-9a-f]{16}"))
    df = df.withColumn("_encoded", F.filter(F.transform(F.transform(apart, _bare), _encoding), lambda x: x["code"].isNotNull()))
    return df.withColumn("_tested", F.transform(F.transform(F.transform(F.transform("_encoded", _placed), _counted), _scored), _tested)).drop("_rest", "_tokens", "_encoded")


def _weighed(p: Column, n: Column) -> Column:
    """p by length, rounded up to a step of its logarithm."""
    return F.ceil(F.log(p / n) * STEPS).cast("int")


def cut_of(docs: DataFrame, rate: float = RATE) -> int | None:
    """The largest weighed p-value at which the share of plain tokens among those reported stays at `rate`, from all candidates of docs(text); null for none."""
    df = docs.select(F.col("text").cast("string").alias("_t")).where(F.col("_t").rlike(TOKEN))
    each = _candidates(_assigned(df)).select(F.explode_outer("_tested").alias("x")).where("x is not null").select(_weighed(F.col("x.p"), F.col("x.n")).alias("at"), F.col("x.n").alias("n"))
    # explode() would push a filter on the tests below all their steps; one row for each step of the logarithm, some 14,000 at most
    steps = each.groupBy("at").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    whole = Window.partitionBy(F.lit(0))
    up = steps.select("at", F.sum("m").over(whole.orderBy("at")).alias("met"), F.sum("m").over(whole).alias("of"), (F.sum("n").over(whole) / F.sum("m").over(whole)).alias("mean"))
    return up.where(F.exp(F.col("at") / STEPS) * F.col("mean") <= rate * F.col("met") / F.col("of")).agg(F.max("at")).head()[0]


def _as(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows of docs(text, ...) with secrets: array<struct<start, rank, end, kind>> by start and kind, in code points, end exclusive.

    Kinds assign, access and hex are the leftmost non-overlapping matches of their patterns, without those that are too
    short; random is what the tests add outside of these. A null or empty text has none. A column `secrets` of docs is
    replaced, other columns stay. The table is read twice: once for the family of candidates, once for the spans.
    """
    cut = cut_of(docs, rate)
    df = _assigned(docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    for kind, pattern, group, least in PATTERNS[1:]:
        df = _matches(df, f"_{kind}", _HEX_RUN if kind == "hex" else pattern, group)
        df = df.withColumn(f"_{kind}", F.filter(f"_{kind}", lambda x, least=least: F.length(x["said"]) >= least))
    df = _candidates(df)
    none = F.expr(f"cast(array() as {_SPAN})")
    random = none if cut is None else F.transform(F.filter("_tested", lambda x: ~x["regular"] & (_weighed(x["p"], x["n"]) <= cut)), _as("random"))
    spans = F.array_sort(F.concat(*(F.transform(f"_{kind}", _as(kind)) for kind, *_ in PATTERNS), random))
    # a filter on the spans would be pushed below all of these steps, each written out as often as later ones use it; nothing is pushed below rand()
    df = df.withColumn("secrets", F.when(F.rand(0) >= 0, spans))
    return df.drop("_t", *(f"_{kind}" for kind, *_ in PATTERNS), "_tested")


def redact(docs: DataFrame, mask: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """docs(text, ...) with each stretch of overlapping secrets replaced by the mask. Texts without secrets, and nulls, stay as they are."""
    df = find_secrets(docs, rate).withColumn("_end", F.when(F.size("secrets") > 0, F.transform("secrets", lambda x: x["end"].cast("long"))))
    df = _running(df, "_end", "_far", F.greatest)
    # what is covered before a span ends where the furthest span so far does
    cuts = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.slice("_far", F.lit(1), F.size("_far") - 1)), "secrets", lambda a, x: F.struct(a.cast("int").alias("from"), x["start"].alias("to")))
    df = df.withColumn("_cuts", F.filter(cuts, lambda x: x["to"] >= x["from"]))
    # a block's stretch of the text is cut out once, and its pieces from that
    stretch = lambda b: F.struct(b.alias("cuts"), F.element_at(b, 1)["from"].alias("low"), F.element_at(b, -1)["to"].alias("high"))
    held = lambda x: F.struct(x["cuts"].alias("cuts"), x["low"].alias("low"), F.substring("text", x["low"] + 1, x["high"] - x["low"]).alias("part"))
    pieces = lambda x: F.array_join(F.transform(x["cuts"], lambda c: F.concat(F.substring(x["part"], c["from"] - x["low"] + 1, c["to"] - c["from"]), F.lit(mask))), "")
    df = df.withColumn("_new", F.array_join(F.transform(F.transform(F.transform(_blocks("_cuts"), stretch), held), pieces), ""))
    rest = F.substring(F.col("text"), F.element_at("_far", -1).cast("int") + 1, F.length("text"))
    return df.withColumn("text", F.when(F.size("secrets") > 0, F.concat("_new", rest)).otherwise(F.col("text"))).drop("secrets", "_end", "_far", "_cuts", "_new")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

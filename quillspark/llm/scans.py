"""Problem 4: noise in text from scanned pages, and its repair.

Furniture: a line near a page's edge is a running header or footer if it comes back on enough pages of its
document, or if a classifier of line pairs (trained on the lines for which recurrence decides) and how often it
comes back say so together, by one rule for documents of any size. A line with only the page number is a number beside such marks as pages carry.

Joins: a line that ends in a hyphen is judged with the next one by a second classifier of line pairs, trained
on words of the corpus cut at random and on its hyphenated compounds.

Misread words: a word that the typed pages don't know retrieves candidates through an inverted join over
its rarest character bigrams (as many as two edits cannot all destroy), and a gradient-boosted ranking,
trained on words misread by rule and on true words withheld, chooses the replacement or none. Numbers with
a letter in the place of a digit need no candidates.

Null and blank pages give no rows. A page delivered several times counts once. Word counts and furniture are
counted over all pages; only the labelled rows of the three models are bounded samples.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.canonical import canonical_text
from quillspark.session import broadcast_if_small, stored

#: Lines from either end of a page that may be furniture; least pages and share of a document.
EDGE, LEAST_PAGES, LEAST_SHARE = 3, 3, 0.1
#: A word is known from so many occurrences on typed pages.
KNOWN = 3
#: Bounds of the labelled samples: words misread by rule, pairs of lines of each kind.
SAMPLE_WORDS, SAMPLE_LINES = 3_000, 20_000
LEAST_SCORE = 0.5
#: How often a line of the text comes back at another page's edge, and the log odds from which a line is furniture.
REPEATED, LEAST_WEIGHT = 0.05, 0.0
#: Distance of two words beyond which it is no longer measured.
FAR = 12
# How scanners misread, as (true, read); letters that stand for digits.
MISREADINGS = [("e", "c"), ("t", "f"), ("d", "cl"), ("n", "ri"), ("h", "b"), ("o", "0"), ("s", "5"), ("l", "1"), ("m", "rn"), ("u", "ii"), ("w", "vv"), ("v", "y"), ("i", "l"), ("c", "e"), ("a", "o"), ("g", "9"), ("f", "t"), ("b", "6")]
NUMBERISH = r"^(?=.*[0-9])(?=.*[OolISBZ])[0-9OolISBZ]+$"
TOKEN = r"[\p{L}\p{N}]+(?:['’]\p{L}+)?"
PAGE_NUMBER = r"(?i)^[\s\-–—|.·*\[\]()]*(?:page|pag\.?|p\.?|seite|s\.|pág\.?)?\s*([0-9OolISB]{1,5})(?:\s*(?:/|of|von|de|di)\s*[0-9OolISB]{1,5})?[\s\-–—|.·*\[\]()]*$"


def _digits(text: Column) -> Column:
    return F.translate(text, "OolISBZ", "0011582")


def skeleton(text: Column) -> Column:
    """A word or line in which letters that scanners confuse are one."""
    out = F.lower(text)
    for true, read in (("m", "rn"), ("w", "vv"), ("d", "cl"), ("u", "ii"), ("n", "ri")):
        out = F.replace(out, F.lit(read), F.lit(true))
    return F.translate(out, "c0oa1itfb685yq9", "eeeellllhhhsvgg")


def scanned_lines(pages: DataFrame) -> DataFrame:
    """Lines of scanned ``pages`` (page_key, document_id, document_name, page_number, text) with the one
    before and after, and whether they lie near an edge. Blank lines stay, for they end paragraphs."""
    rows = pages.filter(F.col("text").rlike(r"\S")).dropDuplicates(["page_key"]).withColumn("lines", F.split("text", "\n"))
    filled = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(r"\S"))
    rows = rows.withColumn("filled", filled)
    n = F.greatest(F.least(F.lit(EDGE), F.size("filled")), F.lit(1))
    rows = rows.withColumn("edges", F.concat(F.slice("filled", F.lit(1), n), F.slice("filled", -n, n)))
    each = F.transform("lines", lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line"), F.get("lines", i - 1).alias("before"), F.get("lines", i + 1).alias("after"), F.array_contains("edges", i).alias("edge")))
    return rows.select("page_key", "document_id", F.lower("document_name").alias("name"), "page_number", F.inline(each))


# Logistic regression of line pairs


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 1e-3, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps on standardised features; ``weight`` is each row's."""
    weight = np.ones(len(x)) if weight is None else weight
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    for _ in range(min(rounds, 30)):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ z + penalty * len(x) * np.eye(z.shape[1])
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - penalty * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def _score(weights: np.ndarray, features: list[Column]) -> Column:
    total = F.lit(float(weights[-1]))
    for w, f in zip(weights, features):
        total = total + F.lit(float(w)) * f.cast("double")
    return 1 / (1 + F.exp(-total))


def _trained(df: DataFrame, features: list[Column], label: Column, default: float, ident: list[str]) -> Column:
    """Probability by a classifier trained on a bounded sample of the rows with a label, drawn by a hash of what
    identifies a row (``ident``). Either label has half of the sample at least, if it has so many rows; beyond
    that, sampled rows weigh as many as they stand for."""
    rows = df.select(*[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)], label.cast("double").alias("y"), F.xxhash64(*ident).alias("draw")).filter("y IS NOT NULL")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    least = min(sizes.values(), default=0)
    room = {y: n if sum(sizes.values()) <= SAMPLE_LINES else max(SAMPLE_LINES // 2, SAMPLE_LINES - least) if n > least else SAMPLE_LINES // 2 for y, n in sizes.items()}
    parts = [rows.filter(F.col("y") == y).orderBy("draw", *rows.columns[:-1]).limit(n).drop("draw").toPandas() for y, n in sorted(room.items())]
    if len(parts) < 2:
        return F.lit(default)
    sample = pd.concat(parts, ignore_index=True)
    weight = np.concatenate([np.full(len(p), sizes[p["y"].iloc[0]] / len(p)) for p in parts])
    return _score(fit_logistic(sample.drop(columns="y").to_numpy(), sample["y"].to_numpy(), weight=weight / weight.mean()), features)


# Furniture


def furniture(lines: DataFrame) -> DataFrame:
    """Page numbers and running headers among ``lines``: page_key, line_no, noise."""
    read = F.regexp_extract("line", PAGE_NUMBER, 1)
    value = F.expr("try_cast(translate(regexp_extract(line, r'%s', 1), 'OolISBZ', '0011582') AS int)" % PAGE_NUMBER.replace("'", "\\'"))
    edge = lines.filter("edge").filter(F.length(F.trim("line")) > 0).withColumn("value", F.when(read.rlike("[0-9]") | (F.length(read) == 1), value))
    offsets = edge.filter("value IS NOT NULL").groupBy("document_id", (F.col("value") - F.col("page_number")).alias("offset")).agg(F.count("*").alias("n"))
    offset = offsets.groupBy("document_id").agg(F.max_by("offset", F.struct("n", -F.abs("offset"))).alias("offset"))
    decorated = F.col("line").rlike(r"(?i)(?:^\s*[-–—|\[(].*[-–—|\])]\s*$|\|\s*$|^\s*\||p\.|page|seite|pag|/| of )")
    numbers = edge.filter("value IS NOT NULL").join(broadcast_if_small(stored(offset)), "document_id", "left")
    is_number = (F.col("value") - F.col("page_number") == F.col("offset")) | (F.col("value") == F.col("page_number")) | decorated
    numbers = numbers.filter(is_number).select("page_key", "line_no", F.lit("page_number").alias("noise"))

    form = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("line"), r"(?U)^[\W_]*[0-9]{0,5}[\W_]+|[\W_]+(?:p\.|page)?\s*[0-9]{0,5}[\W_]*$", " "), r"^[0-9]{1,5}\s|\s[0-9]{1,5}$", " "), r"\s+", " "))
    text = lines.filter(F.col("line").rlike(r"\p{L}")).withColumn("form", form).withColumn("key", F.xxhash64(skeleton(F.col("form"))))
    pages = lines.groupBy("document_id").agg(F.count_distinct("page_key").alias("pages"))
    # Per document and form, then per form: small rows, combined before they are shuffled.
    per = text.groupBy("document_id", "key").agg(F.count_if("edge").alias("at_edge"), F.count_if(~F.col("edge")).alias("inside"))
    overall = per.groupBy("key").agg(F.sum("inside").alias("all_inside"), F.sum("at_edge").alias("all_edge"), F.count_if(F.col("at_edge") > 0).alias("documents"))
    forms = stored(per.join(pages, "document_id").join(overall, "key").filter("at_edge > 0").select("document_id", "key", "at_edge", "pages", "all_inside", "all_edge", "documents"))
    at = stored(text.filter("edge").join(forms, ["document_id", "key"]))
    number = F.regexp_extract(F.lower("line"), r"(?:^\s*[-|]?\s*([0-9oils]{1,5})\s{1,}|\s{1,}[-|]?\s*([0-9oils]{1,5})\s*$)", 0)
    own_number = F.expr("try_cast(regexp_extract(line, '([0-9]+)', 1) AS int)") == F.col("page_number")
    numbered = F.coalesce(own_number & (F.length(F.trim(number)) > 0), F.lit(False))
    n_words = F.size(F.split("form", " "))
    inside = F.log1p(F.col("all_inside").cast("double"))
    features = [
        numbered,
        (n_words >= 2) & F.contains(skeleton(F.col("name")), skeleton(F.col("form"))),
        inside - F.log1p(F.col("all_edge").cast("double")),
        F.col("line").rlike(r"[.!?,;:)-]\s*$"),
        F.least(n_words, F.lit(12)),
        F.coalesce(F.col("after").rlike(r"^\s*\p{Ll}"), F.lit(False)),
        F.coalesce(F.trim("after") == "", F.lit(True)),
        F.coalesce(F.trim("before") == "", F.lit(True)),
        F.col("line").rlike(r"^[^\p{Ll}]+$"),
    ]
    on, of = F.col("at_edge"), F.col("pages")
    recurs = (on >= LEAST_PAGES) & (on >= of * LEAST_SHARE)
    rarely_inside = F.col("all_inside") <= F.col("all_edge") * 0.5
    label = F.when(recurs & rarely_inside, 1).when(on < of * LEAST_SHARE, 0)
    chance = _trained(at, features, label, 0.0, ["page_key", "line_no"])
    # The classifier sees a line's form; how often it came back is weighed with it, alike for documents of any size: a
    # header is on any share of the pages from LEAST_SHARE on with the same chance, a line of the text comes back at
    # an edge with REPEATED.
    weight = F.log(chance / (1 - chance + 1e-12)) - F.log(of.cast("double")) - (on - 1) * float(np.log(REPEATED))
    likely = (on >= of * LEAST_SHARE) & (weight >= LEAST_WEIGHT)
    headers = at.filter((recurs & rarely_inside) | (likely & ~F.col("line").rlike(r"[.!?-]\s*$")))
    return numbers.unionByName(headers.select("page_key", "line_no", F.lit("running_header").alias("noise")).join(numbers.select("page_key", "line_no"), ["page_key", "line_no"], "left_anti")).distinct()


# Words


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def word_counts(typed: DataFrame) -> DataFrame:
    """Words and hyphenated compounds of typed pages (column text), in lower case: word, n."""
    lower = F.lower(canonical_text(F.col("text")))
    compounds = F.regexp_extract_all(F.col("text"), F.lit(r"\p{L}{2,}-\p{L}{2,}"), F.lit(0))
    each = typed.select(lower.alias("text"))
    each = each.select(F.explode(F.concat(_tokens(F.col("text")), compounds)).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n"))


def _ends_in_hyphen(column: str) -> Column:
    return F.col(column).rlike(r"\p{L}[-‐\x{ad}¬]\s*$")


def joins(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Lines that end in a hyphen before a line that begins with a lower-case letter, or with capitals where the
    head is in capitals: page_key, line_no, head,
    tail, and whether they make one word (``joined``)."""
    capitals = F.col("line").rlike(r"(?<![\p{L}\p{N}])\p{Lu}{2,}[-‐\x{ad}¬]\s*$") & F.col("after").rlike(r"^\s*\p{Lu}{2,}(?![\p{L}\p{N}])")
    cut = lines.filter(_ends_in_hyphen("line") & (F.col("after").rlike(r"^\s*\p{Ll}") | capitals))
    pairs = cut.select("page_key", "line_no", F.regexp_extract("line", r"(\p{L}[\p{L}\p{N}]*)[-‐\x{ad}¬]\s*$", 1).alias("head"), F.regexp_extract("after", r"^\s*([\p{L}\p{N}]+)", 1).alias("tail"))
    known = counts.select(F.col("word"), F.log1p(F.col("n").cast("double")).alias("s"))
    few = broadcast_if_small(known)

    def scored(df: DataFrame) -> DataFrame:
        for name, key in (("whole", F.concat("head", "tail")), ("compound", F.concat("head", F.lit("-"), "tail")), ("first", F.col("head")), ("second", F.col("tail"))):
            df = df.withColumn("k", F.lower(key)).join(few.select(F.col("word").alias("k"), F.col("s").alias(name)), "k", "left").drop("k").fillna(0.0, [name])
        return df

    features = [F.col("whole"), F.col("compound"), F.col("first"), F.col("second"), (F.col("whole") > 0), (F.col("compound") > 0), (F.col("first") > 0) & (F.col("second") > 0), F.length("head"), F.length("tail")]
    # Words cut at a place that their hash names, some as if unknown; compounds at their hyphen.
    plain = counts.filter((F.col("n") >= KNOWN) & F.col("word").rlike(r"^\p{L}{5,}$")).withColumn("at", 2 + F.pmod(F.xxhash64("word"), F.length("word") - 3))
    positive = plain.select(F.expr("substring(word, 1, cast(at AS int))").alias("head"), F.expr("substring(word, cast(at AS int) + 1)").alias("tail"), F.lit(1).alias("y"), (F.pmod(F.xxhash64("word", F.lit(7)), F.lit(5)) == 0).alias("hidden"))
    both = counts.filter((F.col("n") >= KNOWN) & F.col("word").contains("-"))
    negative = both.select(F.split_part("word", F.lit("-"), F.lit(1)).alias("head"), F.split_part("word", F.lit("-"), F.lit(2)).alias("tail"), F.lit(0).alias("y"), (F.pmod(F.xxhash64("word", F.lit(7)), F.lit(5)) == 0).alias("hidden"))
    labelled = scored(positive.unionByName(negative)).withColumn("whole", F.when(F.col("hidden"), 0.0).otherwise(F.col("whole"))).withColumn("compound", F.when(F.col("hidden"), 0.0).otherwise(F.col("compound")))
    chance = _trained(labelled, features, F.col("y"), 1.0, ["head", "tail"])
    return scored(pairs).select("page_key", "line_no", "head", "tail", (chance >= 0.5).alias("joined"))


def _bigrams(word: Column) -> Column:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def _distance(a: Column, b: Column) -> Column:
    """Edits between two words, ``FAR`` and beyond as one more, so that very long words cost no more than others."""
    edits = F.levenshtein(a, b, FAR)
    return F.when(edits < 0, FAR + 1).otherwise(edits)


def candidates(words: DataFrame, known: DataFrame) -> DataFrame:
    """Known words within two edits of ``words`` (word), through an inverted join over the five rarest bigrams of each
    (two edits destroy at most four), or equal but for confused letters: word, candidate, n and features. Of words of
    up to three letters all within one edit are found; two may leave no bigram, and hardly a word, of them."""
    postings = known.select(F.col("word").alias("candidate"), "n", F.explode(_bigrams(F.col("word"))).alias("gram"))
    weight = broadcast_if_small(stored(postings.groupBy("gram").agg(F.count("*").alias("df"))))
    grams = words.select("word", F.explode(_bigrams(F.col("word"))).alias("gram")).join(weight, "gram", "left").fillna(0, ["df"])
    rare = grams.groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "gram"))), 1, 5).alias("g")).select("word", F.explode("g.gram").alias("gram"))
    met = rare.join(postings, "gram").filter((F.abs(F.length("word") - F.length("candidate")) <= 2) & (F.col("word") != F.col("candidate"))).select("word", "candidate", "n").distinct()
    near = met.withColumn("edits", F.levenshtein("word", "candidate", 2)).filter("edits >= 0")
    # Words with several misreadings: known words that are equal but for confused letters.
    bones = known.select(F.col("word").alias("candidate"), "n", skeleton(F.col("word")).alias("bones"))
    alike = words.filter(F.length("word") >= 4).withColumn("bones", skeleton(F.col("word"))).join(bones, "bones").filter(F.col("word") != F.col("candidate"))
    near = near.unionByName(alike.select("word", "candidate", "n", _distance(F.col("word"), F.col("candidate")).alias("edits"))).distinct()
    shared = F.size(F.array_intersect(_bigrams(F.col("word")), _bigrams(F.col("candidate"))))
    return near.select(
        "word", "candidate", "n",
        F.col("edits").cast("double").alias("edits"),
        _distance(skeleton(F.col("word")), skeleton(F.col("candidate"))).cast("double").alias("bones"),
        F.log1p(F.col("n").cast("double")).alias("often"),
        F.length("word").cast("double").alias("size"),
        (F.length("word") - F.length("candidate")).cast("double").alias("longer"),
        (shared / F.greatest(F.length("word"), F.length("candidate"))).alias("shared"),
        (F.left("word", F.lit(1)) == F.left("candidate", F.lit(1))).cast("double").alias("same_first"),
        F.col("word").rlike("[0-9]").cast("double").alias("digit"),
    )


FEATURES = ["edits", "bones", "often", "size", "longer", "shared", "same_first", "digit"]


def train_ranking(known: DataFrame):
    """Gradient-boosted trees that tell a misread word's true form from other known words. A sample of known
    words is misread by rule (labelled with the word) or withheld (no candidate is right)."""
    sample = known.filter(F.col("word").rlike(r"^\p{L}{3,}$")).orderBy(F.xxhash64("word")).limit(SAMPLE_WORDS).select(F.col("word").alias("source"))
    rules = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in MISREADINGS])
    fitting = F.filter(rules, lambda r: F.contains(F.col("source"), r["a"]))
    chosen = F.get(fitting, F.pmod(F.xxhash64("source"), F.greatest(F.size(fitting), F.lit(1))).cast("int"))
    later = F.expr("locate(r.a, source, locate(r.a, source) + 1)")
    place = F.when((later > 0) & (F.pmod(F.xxhash64("source", F.lit(3)), F.lit(2)) == 0), later).otherwise(F.expr("locate(r.a, source)"))
    read = F.expr("concat(substring(source, 1, p - 1), r.b, substring(source, p + length(r.a)))")
    misread = sample.withColumn("r", chosen).filter("r IS NOT NULL").withColumn("p", place).select("source", read.alias("word"))
    withheld = sample.filter(F.pmod(F.xxhash64("source", F.lit(11)), F.lit(2)) == 0).select(F.lit("").alias("source"), F.col("source").alias("word"))
    labelled = stored(misread.join(known.select("word"), "word", "left_anti").unionByName(withheld))
    rows = candidates(labelled.select("word").distinct(), known).join(labelled, "word").withColumn("label", (F.col("candidate") == F.col("source")).cast("double"))
    rows = stored(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label"))
    if rows.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=12, maxDepth=4, seed=1).fit(rows)


def corrections(words: DataFrame, known: DataFrame) -> DataFrame:
    """The replacement of each of ``words`` (word, lower case, unknown) that was misread: word, replacement."""
    model = train_ranking(known)
    if model is None:
        return words.select("word", F.lit(None).cast("string").alias("replacement")).filter("false")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(candidates(words, known))
    scored = model.transform(rows).select("word", "candidate", vector_to_array("probability")[1].alias("p"), "often")
    best = scored.groupBy("word").agg(F.max_by(F.struct("candidate", "p"), F.struct("p", "often", "candidate")).alias("x"))
    return best.filter(F.col("x.p") >= LEAST_SCORE).select("word", F.col("x.candidate").alias("replacement"))


def analyse(pages: DataFrame, typed: DataFrame) -> dict[str, DataFrame]:
    """All findings on scanned ``pages``, with word counts of ``typed`` pages (text): ``lines``, ``furniture``,
    ``joins``, ``misread`` (page_key, line_no, token, replacement)."""
    lines = stored(scanned_lines(pages))
    marks = stored(furniture(lines))
    counts = stored(word_counts(typed))
    known = stored(counts.filter((F.col("n") >= KNOWN) & ~F.col("word").contains("-")))
    text = stored(lines.join(marks.select("page_key", "line_no"), ["page_key", "line_no"], "left_anti"))
    cut = stored(joins(text, counts))
    whole = cut.filter("joined")
    # A word cut at a line end is looked up whole, and its halves not on their own.
    head = whole.select("page_key", "line_no", F.lit(True).alias("cut_end"))
    tail = whole.select("page_key", (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("cut_begin"))
    body = text.join(head, ["page_key", "line_no"], "left").join(tail, ["page_key", "line_no"], "left")
    line = F.when(F.col("cut_end"), F.regexp_replace("line", r"\p{L}[\p{L}\p{N}]*[-‐\x{ad}¬]\s*$", "")).otherwise(F.col("line"))
    line = F.when(F.col("cut_begin"), F.regexp_replace(line, r"^\s*[\p{L}\p{N}]+", "")).otherwise(line)
    singles = body.select("page_key", "line_no", F.explode(_tokens(line)).alias("token"))
    halves = whole.select("page_key", "line_no", F.concat("head", "tail").alias("token"), "head", "tail")
    tokens = singles.withColumn("head", F.lit(None).cast("string")).withColumn("tail", F.lit(None).cast("string")).unionByName(halves)
    odd = stored(tokens.withColumn("word", F.lower("token")).join(broadcast_if_small(known.select("word")), "word", "left_anti").filter(~F.col("token").rlike(r"^\p{N}+$")))
    numbers = odd.filter(F.col("token").rlike(NUMBERISH) & F.col("head").isNull()).select("page_key", "line_no", "token", _digits(F.col("token")).alias("replacement"))
    unknown = odd.filter((F.length("word") >= 2) & ~F.col("token").rlike(NUMBERISH))
    fixed = broadcast_if_small(stored(corrections(stored(unknown.select("word").distinct()), known)))
    found = stored(unknown.join(fixed, "word"))
    single = found.filter("head IS NULL").select("page_key", "line_no", "token", "replacement")
    first = found.filter(F.col("head").isNotNull() & ~F.startswith("replacement", F.lower("head"))).select("page_key", "line_no", "token", "replacement")
    second = found.filter(F.col("head").isNotNull() & ~F.endswith("replacement", F.lower("tail"))).select("page_key", (F.col("line_no") + 1).alias("line_no"), "token", "replacement")
    return {"lines": lines, "furniture": marks, "joins": cut, "misread": single.unionByName(numbers).unionByName(first).unionByName(second)}


def noise(pages: DataFrame, typed: DataFrame) -> DataFrame:
    """Noisy lines of scanned ``pages``: page_key, line_no, noise."""
    found = analyse(pages, typed)
    breaks = found["joins"].filter("joined").select("page_key", "line_no", F.lit("hyphen_break").alias("noise"))
    misread = found["misread"].select("page_key", "line_no", F.lit("misread").alias("noise")).distinct()
    return found["furniture"].unionByName(breaks).unionByName(misread)


def repaired(pages: DataFrame, typed: DataFrame) -> DataFrame:
    """Scanned ``pages`` as continuous paragraphs, without furniture, with words joined and corrected:
    page_key, text. A heading (a short line without an end mark before a capital) stays a line of its own."""
    found = analyse(pages, typed)
    fixes = found["misread"].groupBy("page_key", "line_no").agg(F.collect_set(F.struct("token", "replacement")).alias("fixes"))
    rows = found["lines"].join(found["furniture"].select("page_key", "line_no"), ["page_key", "line_no"], "left_anti")
    rows = rows.join(found["joins"].filter("joined").select("page_key", "line_no", F.lit(True).alias("glue")), ["page_key", "line_no"], "left")
    rows = rows.join(fixes, ["page_key", "line_no"], "left")
    per_page = rows.groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "glue", "fixes"))).alias("rows"))

    def cased(token: Column, new: Column) -> Column:
        return F.when(token.rlike(r"^\p{Lu}[\p{Lu}0-9]+$"), F.upper(new)).when(token.rlike(r"^\p{Lu}"), F.concat(F.upper(F.left(new, F.lit(1))), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)

    blank = lambda r: F.length(F.trim(r["line"])) == 0
    heading = lambda r: (F.length(r["line"]) < 45) & r["line"].rlike(r"^\s*\p{Lu}[^.!?,;:]*[^.!?,;:\s-]\s*$") & (F.size(F.split(r["line"], " ")) <= 6)
    joined = F.aggregate("rows", F.lit(""), lambda acc, r: F.when(blank(r), F.concat(F.regexp_replace(acc, r"\s+$", ""), F.lit("\n\n"))).when(r["glue"], F.concat(acc, F.regexp_replace(F.ltrim(r["line"]), r"[-‐\x{ad}¬]\s*$", ""))).when(heading(r), F.concat(acc, F.trim(r["line"]), F.lit("\n\n"))).when(r["line"].rlike(r"\p{L}-\s*$"), F.concat(acc, F.trim(r["line"]))).otherwise(F.concat(acc, F.trim(r["line"]), F.lit(" "))))
    all_fixes = F.array_distinct(F.flatten(F.transform(F.filter("rows", lambda r: r["fixes"].isNotNull()), lambda r: r["fixes"])))
    text = F.aggregate(all_fixes, F.regexp_replace(joined, r"^\s+|\s+$", ""), lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), x["token"], F.lit(r"(?![\p{L}\p{N}])")), cased(x["token"], x["replacement"])))
    return per_page.select("page_key", text.alias("text"))

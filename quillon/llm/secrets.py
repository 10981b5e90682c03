"""Secret scan: candidates by shape, false positives removed by a random forest; DataFrame functions only.

A candidate is a maximal run of 16 or more characters of [A-Za-z0-9+/=_-] that
holds a digit. The forest judges its length, changes of character class, cover
by dictionary words, share of distinct characters and digits, signs of a path
around it, and the words before it. It is trained on the driver from labelled
findings (at most `MOST_FINDINGS`; by default a seeded list made here from the
shapes of known keys and of known look-alikes) and becomes one column expression.
Every candidate of a text is judged within the row, so nothing is shuffled.

What is no candidate is never found: values shorter than 16 characters or without a
digit, and each part of a value between dots or other marks is judged by itself.

Cases: a null text stays null without findings; an empty text stays empty; a text
of candidates only and repeated rows need no special care; in very long texts the
work grows with the candidates, and the place of a finding costs one block of
candidates and the number of blocks before it; an
empty table gives an empty result; all other columns stay, but for those named
like the three results, which give way to them.
"""

from __future__ import annotations

import math
import random
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import forest as RF

CANDIDATE = r"[A-Za-z0-9+/=_\-]{16,}"
#: A text with no match has no candidate: the look-behind keeps it to one try a run.
SOME = r"(?<![A-Za-z0-9+/=_\-])(?=[A-Za-z+/=_\-]*[0-9])[A-Za-z0-9+/=_\-]{16,}"
BEFORE, AFTER = 48, 16
MOST_FINDINGS = 20_000
REDACTED = "[SECRET]"
RESULTS = ("n_candidates", "secrets", "redacted")

# Common English, code and licence words of three letters or more.
WORDS = (
    "the and for with from that this have not are get use man new call change class client code config content control copy count create current data date "
    "default delete description development device directory document domain down element email enable end engine error event example export false field "
    "file find first folder form format function generate host http image import index info init input insert install interface item join json key label "
    "language length license like line link list load local location log login long main map master match member message method model name network number "
    "open option order other output over package page path permission plugin point port position post process project property provider query range read "
    "remote request reset resource response result return route search section select send sequence server service session set setting share start store "
    "string style table tag target task template test text time title token tool total transaction true type update url user util value variable version "
    "window work world write"
).split()
KEYWORDS = r"(secret|token|passw|pwd|api.?key|access.?key|auth|credential|private|bearer|client.?key|signing)"
LOOKALIKE = r"(commit|sha.?1|sha.?256|md5|checksum|uuid|guid|digest|example|integrity|revision|fingerprint|etag|hash|blob|image|href|src|url|http)"


def _in(pattern: str, before: Column) -> Column:
    return before.rlike("(?i)" + pattern).cast("double")


def features(c: Column, before: Column, after: Column) -> Column:
    """The features of candidate c, as a struct of doubles."""
    n = F.length(c).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")).cast("double")
    letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
    bare = F.regexp_replace(F.lower(c), "(" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")", "")
    left = F.length(F.regexp_replace(bare, "[^a-z]", "")).cast("double")
    n_letters = F.length(letters).cast("double")
    return F.struct(
        n.alias("length"),
        ((runs - 1) / n).alias("changes"),
        F.when(n_letters > 0, (n_letters - left) / n_letters).otherwise(F.lit(0.0)).alias("dictionary"),
        (F.size(F.array_distinct(F.split(c, ""))).cast("double") / n).alias("distinct"),
        (F.length(F.regexp_replace(c, "[^0-9]", "")).cast("double") / n).alias("digits"),
        c.rlike(r"^[0-9a-fA-F]+\z").cast("double").alias("hex"),
        (F.length(F.regexp_replace(c, "[^/_-]", "")).cast("double") / n).alias("joints"),
        _in(r"[./\\]\z|[./\\][\w.-]*\z", before).alias("path"),
        after.rlike(r"^[./\\]").cast("double").alias("path_after"),
        _in(KEYWORDS + r"[^\n]{0,24}\z", before).alias("keyword"),
        _in(LOOKALIKE + r"[^\n]{0,24}\z", before).alias("lookalike"),
        _in(r"[=:]\s*[\"']?\z", before).alias("assigned"),
        (before.rlike("[\"'`]\\z") & after.rlike("^[\"'`]")).cast("double").alias("quoted"),
        c.rlike(r"^(AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk_live|sk-|AIza|glpat-|eyJ)").cast("double").alias("prefix"),
    )


def plain_features(c: str, before: str, after: str) -> dict[str, float]:
    """The same features on Python strings, for training."""
    n = len(c)
    kinds = re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", c)))
    letters = re.sub("[^a-z]", "", c.lower())
    bare = re.sub("(" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")", "", c.lower())
    left = len(re.sub("[^a-z]", "", bare))
    has = lambda p, s: float(re.search(p, s, re.I | re.A) is not None)
    return {
        "length": float(n),
        "changes": (len(re.sub(r"(.)\1+", r"\1", kinds)) - 1) / n,
        "dictionary": (len(letters) - left) / len(letters) if letters else 0.0,
        "distinct": len(set(c)) / n,
        "digits": sum(x in string.digits for x in c) / n,
        "hex": float(re.fullmatch("[0-9a-fA-F]+", c) is not None),
        "joints": sum(x in "/_-" for x in c) / n,
        "path": has(r"[./\\]\Z|[./\\][\w.-]*\Z", before),
        "path_after": has(r"\A[./\\]", after),
        "keyword": has(KEYWORDS + r"[^\n]{0,24}\Z", before),
        "lookalike": has(LOOKALIKE + r"[^\n]{0,24}\Z", before),
        "assigned": has(r"[=:]\s*[\"']?\Z", before),
        "quoted": float(bool(re.search("[\"'`]\\Z", before) and re.match("[\"'`]", after))),
        "prefix": float(re.match(r"(AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk_live|sk-|AIza|glpat-|eyJ)", c) is not None),
    }


def made_findings(n: int = 2400, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, 1 if a secret): shapes of keys, and of what is mistaken for them."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    talk = lambda: " ".join(some(string.ascii_lowercase, r.randint(2, 9)) for _ in range(r.randint(1, 6)))
    key = lambda: r.choice(["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "client_secret", "private_key", "SECRET_KEY", "bearer"])
    out = []
    for _ in range(n // 2):
        q = r.choice(["\"", "'", ""])
        sep = r.choice([" = ", "=", ": ", " := ", " => ", " "])
        kind = r.randrange(6)
        if kind == 0:
            c = some(hexa, r.choice([32, 40, 40, 40, 64]))
        elif kind == 1:
            c = r.choice(["AKIA", "ASIA"]) + some(string.ascii_uppercase + string.digits, 16)
        elif kind == 2:
            c = r.choice(["ghp_", "gho_", "xoxb-", "sk_live_", "sk-", "AIza", "glpat-"]) + some(alnum, r.choice([24, 32, 36]))
        elif kind == 3:
            c = some(alnum + "+/", r.choice([32, 40, 44, 64])) + r.choice(["", "=", "=="])
        elif kind == 4:
            c = some(alnum, r.randint(20, 48))
        else:
            c = "eyJ" + some(alnum + "-_", r.randint(40, 90))
        bare = kind in (1, 2) and r.random() < 0.5
        before = talk() + " " + ("" if bare else key() + sep) + q
        out.append((before[-BEFORE:], _with_digit(c, r), (q + r.choice([" ", "\n", ",", ";"]) + talk())[:AFTER], 1))
    for _ in range(n - n // 2):
        kind = r.randrange(9)
        q = r.choice(["\"", ""])
        before, after = talk() + " ", " " + talk()
        if kind == 0:
            c, before = some(hexa, r.choice([32, 40, 64])), talk() + r.choice([" commit ", " sha1: ", " sha256=", " md5 ", " checksum: ", " hash ", " integrity "]) + q
        elif kind == 1:
            c = "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))
            before = talk() + r.choice([" uuid ", " id: ", " guid = ", " "]) + q
        elif kind == 2:
            c = r.choice(["_", "-", ""]).join(r.choice(WORDS) for _ in range(r.randint(3, 6))) + str(r.randint(1, 99))
        elif kind == 3:
            c = "/".join(r.choice(WORDS) for _ in range(r.randint(3, 7))) + "/" + str(r.randint(1, 2030))
            before, after = before + r.choice(["./", "../", "http://", "https://", "/usr/"]), r.choice([".py", ".html", ".txt", "/"]) + after
        elif kind == 4:
            c = some(string.digits, r.randint(16, 24))
        elif kind == 5:
            c = r.choice("xX0*=-_") * r.randint(16, 40) + "1"
            before = talk() + " " + key() + r.choice([" = ", "="]) + q
        elif kind == 6:
            c = "".join(r.choice(WORDS).capitalize() for _ in range(r.randint(3, 5))) + str(r.randint(1, 9))
            before = talk() + " " + r.choice(["", key() + " = "])
        elif kind == 7:
            c = "your_" + "_".join(r.choice(["api", "token", "key", "here", "secret", "example"]) for _ in range(3)) + str(r.randint(1, 9))
            before = talk() + " " + key() + "=" + q
        else:
            c = "".join(some("bcdfghklmnprst", 1) + r.choice(["a", "e", "i", "o", "u", "er", "ing", "ion"]) for _ in range(r.randint(6, 14))) + r.choice(["1", "2", "-1", "=3"])
        out.append((before[-BEFORE:], _with_digit(c, r), after[:AFTER], 0))
    return out


def _with_digit(c: str, r: random.Random) -> str:
    if any(x in string.digits for x in c):
        return c
    k = r.randrange(len(c))
    return c[:k] + r.choice(string.digits) + c[k + 1 :]


def labelled(findings: DataFrame, most: int = MOST_FINDINGS) -> list[tuple[str, str, str, int]]:
    """Labelled findings of a table (before, candidate, after, label 0 or 1) for training: at most `most`, chosen by hash; rows with a null are left out."""
    own = findings.select(F.substring("before", -BEFORE, BEFORE).alias("b"), F.col("candidate").cast("string").alias("c"), F.substring("after", 1, AFTER).alias("a"), F.col("label").cast("int").alias("y")).dropna()
    return [(r["b"], r["c"], r["a"], r["y"]) for r in own.orderBy(F.xxhash64("b", "c", "a"), "c", "y").limit(most).collect()]


def train(findings: DataFrame | list[tuple[str, str, str, int]] | None = None) -> list[RF.Node]:
    """The forest from labelled findings: a table as `labelled` reads it, a list (before, candidate, after, label), or the made list."""
    rows = made_findings() if findings is None else findings if isinstance(findings, list) else labelled(findings)
    if not rows or len(rows) > MOST_FINDINGS:
        raise ValueError(f"1 to {MOST_FINDINGS} labelled findings are needed")
    return RF.train([(plain_features(c, b, a), y) for b, c, a, y in rows])


#: Lengths are added up in blocks of so many, so that the place of a finding costs its block and the blocks before it.
BLOCK = 256


def scan(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5, model: list[RF.Node] | None = None) -> DataFrame:
    """docs with `n_candidates`, `secrets` array<struct<char_start, n_chars, score>> (the values themselves go nowhere) and `redacted` in place of each secret."""
    model = model if model is not None else train()
    text = F.col("_scan.text")
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns if c not in RESULTS]).alias("_row"), F.struct(docs[text_col].cast("string").alias("text"), docs[text_col].rlike(SOME).alias("some")).alias("_scan"))
    cut = inner.select(
        "_row", "_scan",
        F.when(F.col("_scan.some"), F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))).alias("_found"),
        F.when(F.col("_scan.some"), F.split(text, CANDIDATE, -1)).alias("_parts"),
    )
    has_digit = lambda c: c.rlike("[0-9]")
    around = lambda c, i: features(c, F.substring(F.get("_parts", i), -BEFORE, BEFORE), F.substring(F.get("_parts", i + 1), 1, AFTER))
    featured = cut.withColumn("_f", F.transform("_found", lambda c, i: F.when(has_digit(c), around(c, i))))
    scored = featured.withColumn("_score", F.transform("_f", lambda f: F.when(f.isNotNull(), RF.expression(model, f))))
    # characters of each part with the candidate behind it, and of blocks of them
    sums = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    lengths = scored.withColumn("_n", F.transform("_parts", lambda p, i: (F.length(p) + F.coalesce(F.length(F.get("_found", i)), F.lit(0))).cast("long")))
    blocks = lengths.withColumn("_blocks", F.transform(F.sequence(F.lit(0), F.floor(F.size("_n") / BLOCK).cast("int")), lambda b: sums(F.slice("_n", b * BLOCK + 1, BLOCK))))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    start = lambda i: sums(F.slice("_blocks", 1, block(i))) + sums(F.slice("_n", block(i) * BLOCK + 1, i % BLOCK)) + F.length(F.get("_parts", i))
    hits = F.filter(F.transform("_score", lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: x["s"] >= threshold)
    secrets = F.transform(hits, lambda x: F.struct(start(x["i"]).alias("char_start"), F.length(F.get("_found", x["i"])).cast("long").alias("n_chars"), x["s"].alias("score")))
    glued = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, F.when(F.get("_score", i) >= threshold, F.lit(REDACTED)).otherwise(F.coalesce(F.get("_found", i), F.lit(""))))), "")
    none = F.array().cast("array<struct<char_start:bigint,n_chars:bigint,score:double>>")
    listed = blocks.withColumn("_secrets", F.coalesce(secrets, none))
    return listed.select(
        "_row.*", F.coalesce(F.size(F.filter("_f", lambda f: f.isNotNull())), F.lit(0)).cast("long").alias("n_candidates"), F.col("_secrets").alias("secrets"), F.when(F.size("_secrets") > 0, glued).otherwise(text).alias("redacted"),
    ).withColumn("n_candidates", F.greatest("n_candidates", F.lit(0).cast("long")))


def sql(model: list[RF.Node] | None = None, threshold: float = 0.5) -> str:
    """DuckDB SQL of op5's registered query: (doc_id, n_candidates, n_secrets, places, redacted_sha256)."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    flag = lambda c: f"({c})::int::double"
    words = "(" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")"
    letters = "length(regexp_replace(lower(c), '[^a-z]', '', 'g'))"
    left = f"length(regexp_replace(regexp_replace(lower(c), {quoted(words)}, '', 'g'), '[^a-z]', '', 'g'))"
    kinds = "regexp_replace(regexp_replace(regexp_replace(c, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '0', 'g')"
    has = lambda p, of="b": flag(f"regexp_matches({of}, {quoted(p)})")
    exprs = {
        "length": "length(c)::double",
        "changes": "len(list_filter(range(1, length(c)), lambda j: k[j] <> k[j + 1]))::double / length(c)",
        "dictionary": f"case when {letters} > 0 then ({letters}::double - {left}) / {letters} else 0.0 end",
        "distinct": "len(list_distinct(string_split(c, '')))::double / length(c)",
        "digits": "length(regexp_replace(c, '[^0-9]', '', 'g'))::double / length(c)",
        "hex": has(r"^[0-9a-fA-F]+\z", "c"),
        "joints": "length(regexp_replace(c, '[^/_-]', '', 'g'))::double / length(c)",
        "path": has(r"(?i)[./\\]\z|[./\\][\w.-]*\z"),
        "path_after": has(r"^[./\\]", "a"),
        "keyword": has("(?i)" + KEYWORDS + r"[^\n]{0,24}\z"),
        "lookalike": has("(?i)" + LOOKALIKE + r"[^\n]{0,24}\z"),
        "assigned": has(r"(?i)[=:]\s*[\"']?\z"),
        "quoted": flag("""regexp_matches(b, '["''`]\\z') and regexp_matches(a, '^["''`]')"""),
        "prefix": has(r"^(AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk_live|sk-|AIza|glpat-|eyJ)", "c"),
    }

    def tree(n: RF.Node) -> str:
        return f"{n.share!r}::double" if n.feature is None else f'case when "f_{n.feature}" <= {n.most!r}::double then {tree(n.low)} else {tree(n.high)} end'

    model = model if model is not None else train()
    forest = "(" + " + ".join(map(tree, model)) + f") / {float(len(model))!r}::double"
    columns = ", ".join(f'{e} "f_{name}"' for name, e in exprs.items())
    return f"""
with d as (select doc_id, text, regexp_extract_all(text, {quoted(CANDIDATE)}) f, regexp_split_to_array(text, {quoted(CANDIDATE)}) p from documents),
i as (select doc_id, f, p, unnest(range(1, len(f) + 1)) i from d where len(f) > 0),
c as (select doc_id, i, f[i] c, right(p[i], {BEFORE}) b, left(p[i + 1], {AFTER}) a, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) at0 from i where regexp_matches(f[i], '[0-9]')),
k as (select *, string_split({kinds}, '') k from c),
x as (select doc_id, i, c, at0, {columns} from k),
s as (select *, {forest} s from x),
h as (select doc_id, count(*) n, count(*) filter (s >= {threshold!r}) m, string_agg(at0::bigint::varchar || '+' || length(c)::varchar, ',' order by i) filter (s >= {threshold!r}) places, list(i order by i) filter (s >= {threshold!r}) hit from s group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint n_candidates, coalesce(m, 0)::bigint n_secrets, coalesce(places, '') places,
       sha256(case when coalesce(m, 0) = 0 then text else array_to_string(list_transform(range(1, len(p) + 1), lambda j: p[j] || case when list_contains(hit, j) then {quoted(REDACTED)} else coalesce(f[j], '') end), '') end) redacted_sha256
from d left join h using (doc_id)
"""

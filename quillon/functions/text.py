"""Column functions on text: normal forms, sentences, options, answers, n-grams, scores.

`lower` stands for case folding throughout (they differ for a few letters such as
the German sharp s). White space is the ASCII set that both engines share.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\x0B\f\r]+"
BLANKS = " \t\n\x0b\f\r"
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # Unicode's space separators, which SQL's trim takes


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), 0)


def norm_ascii(x: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces, trimmed (H1)."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def norm_underscore(x: Column) -> Column:
    """The same with underscores, none at the ends (H2)."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def squeeze(x: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(x, WS, " "))


def norm_space(x: Column, empty: str | None = None) -> Column:
    """Lower case with white space collapsed; `empty` in place of nothing (H3)."""
    n = F.lower(squeeze(x))
    return n if empty is None else F.coalesce(F.nullif(n, F.lit("")), F.lit(empty))


def norm_unicode(x: Column) -> Column:
    """Lower case, runs of characters that are no Unicode word characters as spaces (H4)."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)[^\w]+", " "))


def nfkc(x: Column) -> Column:
    """Unicode's compatibility composition. Texts of ASCII alone, which it doesn't change, stay in the JVM."""

    @F.pandas_udf("string")
    def compose(v: pd.Series) -> pd.Series:
        return v.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    foreign = F.octet_length(x) != F.length(x)
    return F.when(foreign, compose(F.when(foreign, x))).otherwise(x)


def norm_concept(x: Column, compose: bool = False) -> Column:
    """Collapsed, without ` ;,.` at either end, lower case (H5); with compose=True compatibility forms (ligatures, full width, superscripts) are their plain ones first."""
    return F.lower(F.regexp_replace(F.regexp_replace(nfkc(x) if compose else x, WS, " "), "^[ ;,.]+|[ ;,.]+$", ""))


def words(x: Column) -> Column:
    """White-space-separated words."""
    return F.filter(F.split(x, WS), lambda w: w != "")


def sentences(x: Column, ends: str = ".!?", lines: bool = False) -> Column:
    """Pieces after which one of `ends` and white space stand, with `lines` also those that end with a line."""
    return F.split(x, f"(?<=[{ends}]){WS}" + (r"|\n+" if lines else ""))


def strip(x: Column) -> Column:
    """Without white space at either end; a run of it within the text is passed once."""
    return F.btrim(x, F.lit(BLANKS))


def clean_caption(x: Column) -> Column:
    """struct<text, rules>: tags and exported paths removed, white space collapsed, repeated sentences dropped (H6). Each step runs once a row."""

    def no_tags(o: Column) -> Column:
        rest = F.substring_index(o, ">", -1)  # no tag ends in it, so each `<` before it finds its `>` nearby
        return F.when(F.contains(o, F.lit("<")), F.concat(F.regexp_replace(F.substring(o, F.lit(1), F.length(o) - F.length(rest)), "<[^>]+>", " "), rest)).otherwise(o)

    def no_paths(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("/")), F.regexp_replace(t, r"(?:[A-Za-z]:\\|/)(?:[^\s,;]+/)+[^\s,;]+", " ")).otherwise(t)

    def told(original: Column, untagged: Column, bare: Column, parts: Column, kept: Column) -> Column:
        rules = F.array_compact(
            F.array(
                F.when(untagged != original, F.lit("strip_html")),
                F.when(bare != untagged, F.lit("strip_export_path")),
                F.when(F.size(kept) != F.size(parts), F.lit("dedupe_sentence")),
            )
        )
        return F.struct(F.array_join(kept, " ").alias("text"), rules.alias("rules"))

    def distinct(o: Column, t: Column, p: Column) -> Column:
        return let(sentences(F.btrim(squeeze(p), F.lit(SPACES))), lambda parts: let(F.array_remove(F.array_distinct(parts), ""), lambda kept: told(o, t, p, parts, kept)))

    return let(strip(x), lambda o: let(no_tags(o), lambda t: let(no_paths(t), lambda p: distinct(o, t, p))))


def strip_citations(x: Column) -> Column:
    """`[1, 2]` marks removed (H7)."""
    return F.regexp_replace(x, r"\[[0-9]+(?:, *[0-9]+)*\]", "")


def final_part(x: Column) -> Column:
    """What stands after the last `final answer:` (H7)."""
    parts = F.split(x, r"(?i)final\s+answer\s*:")
    return F.element_at(parts, -1)


def reasoning_part(x: Column) -> Column:
    """What stands before the first `final answer:` (H7)."""
    return F.get(F.split(x, r"(?i)final\s+answer\s*:"), 0)


def option_map(prompt: Column) -> Column:
    """map<letter, text> of the lines `A. text` (H8); the first line of a letter counts."""
    line = r"(?m)^[ \t]*([A-Z])\.[ \t]*(\S.*?)[ \t]*$"
    both = F.arrays_zip(F.regexp_extract_all(prompt, F.lit(line), F.lit(1)).alias("k"), F.regexp_extract_all(prompt, F.lit(line), F.lit(2)).alias("v"))
    firsts = let(both, lambda b: F.filter(b, lambda x, i: F.size(F.filter(F.slice(b, 1, i), lambda y: y["k"] == x["k"])) == 0))
    return F.map_from_entries(firsts)


def named_letter(x: Column) -> Column:
    """The letter of an answer: first standalone letter, or null."""
    return F.nullif(F.upper(F.regexp_extract(x, r"(?i)\b([A-Z])(?:[.):]|\b)", 1)), F.lit(""))


def answer_matches(options: Column, reference: Column, raw: Column) -> Column:
    """Whether an answer names the reference's option, or contains its text."""
    pick = lambda t: F.when(named_letter(t).isNotNull(), F.coalesce(options[named_letter(t)], F.lit(""))).otherwise(t)
    mine, ref = norm_ascii(pick(raw)), norm_ascii(pick(reference))
    return (mine != "") & ((mine == ref) | F.contains(norm_ascii(raw), ref))


def answer_index(raw: Column, letters: Column, values: Column) -> Column:
    """0-based option that an answer means, or null (H9): a leading or named letter decides alone, right or not;
    else the one option equal to the answer, the one it starts with, the one it contains."""
    n = norm_unicode(raw)
    opts = F.transform(values, norm_unicode)
    lead = F.regexp_extract(raw, r"^\s*[(\[]?([A-Za-z])[)\].:](?:\s|$)|^\s*([A-Za-z])\s*$", 0)
    named = F.regexp_extract(raw, r"(?i)(?:answer|option|choice)(?:\s*(?:is|:))*\s*[(\[]?([A-Za-z])(?![A-Za-z])", 1)
    letter = F.upper(F.coalesce(F.nullif(F.regexp_extract(lead, "([A-Za-z])", 1), F.lit("")), F.nullif(named, F.lit(""))))
    by_letter = F.nullif(F.array_position(letters, letter), F.lit(0).cast("long")) - 1
    only = lambda test: (lambda hit: F.when(F.size(hit) == 1, F.get(hit, 0)))(F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: test(F.get(opts, i))))
    same = only(lambda o: n == o)
    starts = only(lambda o: n.startswith(F.concat(o, F.lit(" "))) | n.startswith(F.concat(F.lit("the answer is "), o)) | n.startswith(F.concat(F.lit("answer "), o)))
    holds = only(lambda o: (o != "") & F.contains(F.concat(F.lit(" "), n, F.lit(" ")), F.concat(F.lit(" "), o, F.lit(" "))))
    return F.when(letter.isNotNull(), by_letter).otherwise(F.coalesce(same, starts, holds).cast("long"))


def concept_set(x: Column, delimiters: str = r"[;\n,]+", core: bool = False) -> Column:
    """Distinct normal concepts of a delimited list; core drops `uncertain` and `negated`."""
    c = F.filter(F.transform(F.split(x, delimiters), norm_ascii), lambda v: v != "")
    return F.array_distinct(F.transform(c, lambda v: F.regexp_replace(v, "^(?:uncertain|negated) ", "")) if core else c)


def ngrams(w: Column, n: int) -> Column:
    """Runs of n words, joined by a space; empty for fewer words."""
    runs = F.greatest(F.size(w) - (n - 1), F.lit(0))
    joined = F.slice(w, 1, runs)
    for j in range(1, n):  # word j of each run beside the words before it: no run is cut out by itself
        joined = F.zip_with(joined, F.slice(w, j + 1, runs), lambda a, b: F.concat(a, F.lit(" "), b))
    return joined


def bigram_ratio(x: Column) -> Column:
    """Distinct bigrams to bigrams of the words [a-z0-9]+; 1 for fewer than three words."""
    return lower_bigram_ratio(F.lower(x))


def lower_bigram_ratio(x: Column) -> Column:
    """bigram_ratio of a text in lower case."""
    found = F.regexp_extract_all(x, F.lit("([a-z0-9]+)"), F.lit(1))
    return let(found, lambda w: F.when(F.size(w) < 3, 1.0).otherwise(let(ngrams(w, 2), lambda g: F.size(F.array_distinct(g)) / F.size(g))))


def repetition_penalty(x: Column, n: int, most: float) -> Column:
    """(1 - distinct/total n-grams) * most; 0 for short or empty texts."""
    made = let(words(F.lower(x)), lambda w: ngrams(w, n))
    return let(made, lambda g: F.when(F.size(g) == 0, 0.0).otherwise((1 - F.size(F.array_distinct(g)) / F.size(g)) * most))


def think_format(x: Column) -> Column:
    """1.0 if the text is `<think>...</think> <answer>...</answer>` and nothing else."""
    return x.rlike(r"(?sm)\A<think>.*?</think>\s*<answer>.*?</answer>(?![\s\S])").cast("double")


def react_format(x: Column) -> Column:
    """1.0 if thoughts are followed by an action and its input."""
    return x.rlike(r"(?sm)\A<think>.*?</think>\s*Action:.*?Action Input:.*?$").cast("double")


def boxed(x: Column) -> Column:
    """The content of the first `\\boxed{}` that isn't empty, else of `<answer>`, which may be empty, else the text."""
    answer = r"(?s)<answer>(.*?)</answer>"
    b, a = F.regexp_extract(x, r"\\boxed\{([^{}]*)\}", 1), F.regexp_extract(x, answer, 1)
    return F.trim(F.when(b != "", b).when((a != "") | x.rlike(answer), a).otherwise(x))


def last_action(x: Column) -> Column:
    """struct<action, input> of the last `Action:` and `Action Input:`; `none` and `{}` if missing."""
    a = F.trim(F.substring_index(F.element_at(F.split(x, r"Action:"), -1), "\n", 1))
    i = F.trim(F.element_at(F.split(x, r"Action Input:"), -1))
    return F.struct(F.when(F.contains(x, F.lit("Action:")), a).otherwise("none").alias("action"), F.when(F.contains(x, F.lit("Action Input:")), i).otherwise("{}").alias("input"))


def tool_calls(x: Column) -> Column:
    """array<struct<name, arguments>> of all `<tool_call>` JSON objects with both keys."""
    raw = F.regexp_extract_all(x, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    parsed = F.transform(raw, lambda j: F.struct(F.get_json_object(j, "$.name").alias("name"), F.get_json_object(j, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def fill(template: Column, **values: Column) -> Column:
    """`{{NAME}}` places filled literally."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), F.coalesce(v, F.lit("")))
    return template


def router_choice(output: Column, sample_id: Column, experts: list[int], seed: int = 42) -> Column:
    """struct<expert, valid>: the one named expert, else a hash of seed, id and output over the experts."""
    named = F.regexp_extract_all(F.upper(output), F.lit(r"EXPERT[_\s-]*0*([1-9]\d*)"), F.lit(1))
    one = F.get(named, 0).cast("int")
    ok = (F.size(named) == 1) & one.isin(*experts)
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), sample_id.cast("string"), output), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("decimal(38,0)") * F.lit(2**32).cast("decimal(38,0)") + F.conv(F.substring(digest, 9, 8), 16, 10).cast("decimal(38,0)")
    pick = F.element_at(F.array(*[F.lit(e) for e in experts]), (number % len(experts)).cast("int") + 1)
    return F.struct(F.when(ok, one).otherwise(pick).alias("expert"), ok.alias("valid"))


def error_category(status: Column, message: Column) -> Column:
    """`none`, `http_nnn`, or the message cut to 80 characters."""
    v = F.coalesce(F.nullif(message, F.lit("")), F.nullif(status, F.lit("")), F.lit("unknown"))
    code = F.regexp_extract(v, r"Error code: (\d{3})", 1)
    return F.when(status == "success", "none").when(code != "", F.concat(F.lit("http_"), code)).otherwise(F.when(F.length(v) <= 80, v).otherwise(F.concat(F.substring(v, 1, 77), F.lit("..."))))


def vqa_output(raw: Column, options: Column, gold: Column) -> Column:
    """struct<letter, answer, valid, correct>: an anchored A-D letter, else the text itself."""
    n = squeeze(raw)
    hit = n.rlike(r"(?i)^[A-D](?:[ .):\-]|$)")
    letter = F.when(hit, F.upper(F.substring(n, 1, 1)))
    text = F.when(hit, F.trim(F.regexp_replace(n, r"(?i)^[A-D]\s*[.):\-]?\s*", ""))).otherwise(n)
    valid = letter.isNotNull() & F.array_contains(F.map_keys(options), letter)
    answer = F.when(F.coalesce(valid, F.lit(False)) & (text == ""), options[letter]).otherwise(text)
    golds = F.filter(F.map_keys(options), lambda k: norm_space(options[k]) == norm_space(gold))
    right = (F.coalesce(valid, F.lit(False)) & F.coalesce(letter == F.get(golds, 0), F.lit(False))) | (norm_space(answer) == norm_space(gold))
    return F.struct(letter.alias("letter"), answer.alias("answer"), F.coalesce(valid, F.lit(False)).alias("valid"), right.alias("correct"))


def split_by(x: Column, delimiters: list[str]) -> Column:
    """array<struct<key, content>>: the delimiters met and what follows each; joined again they are the text."""
    import re

    pattern = "|".join(re.escape(d) for d in delimiters)
    keys = F.concat(F.array(F.lit("")), F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1)))
    parts = F.split(x, pattern, -1)
    both = F.zip_with(keys, parts, lambda k, p: F.struct(k.alias("key"), p.alias("content")))
    return F.filter(both, lambda p: (p["key"] != "") | (p["content"] != ""))


def lineage_tokens(family: Column, ids: dict[str, Column], paths: Column) -> Column:
    """Sorted distinct tokens `kind:family:value` of ids and of image stems of five characters or more."""
    named = [F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.concat(F.lit(f"{k}:"), family, F.lit(":"), norm_underscore(v))) for k, v in ids.items()]
    stem = lambda p: norm_underscore(F.regexp_replace(F.regexp_replace(p, r"^.*[/\\]", ""), r"\.[^.]*$", ""))
    images = F.transform(paths, lambda p: F.when(F.length(stem(p)) >= 5, F.concat(F.lit("image:"), family, F.lit(":"), stem(p))))
    cases = F.transform(paths, lambda p: F.when(F.lower(p).rlike(r"case[0-9]+"), F.concat(F.lit("case:"), F.regexp_extract(F.lower(p), r"(case[0-9]+)", 1))))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*named), images, cases))))


def by_first(pattern: str) -> str:
    """The same pattern, its plain alternatives tried only where one of their first letters stands."""
    plain = pattern.split("|")
    return f"(?=[{''.join(sorted({w[0] for w in plain}))}])(?:{pattern})" if all(w.isascii() and w.isalnum() for w in plain) else pattern


def quality_score(x: Column, terms: str, artifacts: str, hedges: str) -> Column:
    """struct<score, flags>: a capped sum of term counts, length and repetition bands, within 0..100 (H26). Each fact is found once a row."""
    count = lambda t, p: F.regexp_count(t, F.lit(by_first(p))).cast("double")
    flag = lambda c, name: F.when(c, F.lit(name))

    def facts(t: Column) -> Column:
        cut = ~F.right(strip(x), F.lit(1)).isin(*".!?:;")
        return F.struct(F.length(x).alias("n"), lower_bigram_ratio(t).alias("r"), count(t, terms).alias("terms"), count(t, artifacts).alias("artifacts"), count(t, hedges).alias("hedges"), cut.alias("cut"))

    def told(f: Column) -> Column:
        n, r, cut = f["n"], f["r"], f["cut"]
        score = (
            F.lit(48.0) + F.least(F.lit(18.0), f["terms"] * 3) + F.when(n.between(450, 1500), 7.0).when(n.between(300, 1900), 2.0).otherwise(-7.0)
            + F.when(r >= 0.82, 7.0).when(r >= 0.65, 2.0).otherwise(-9.0) - F.least(F.lit(18.0), f["artifacts"] * 3) - F.least(F.lit(24.0), f["hedges"] * 5)
        )
        score = score - F.when(cut, 2.0).otherwise(0.0)
        flags = F.array_compact(F.array(flag(f["artifacts"] > 0, "artifact"), flag(f["hedges"] > 0, "hedging"), flag(r < 0.65, "repetitive"), flag(n < 300, "short"), flag(n > 1900, "long"), flag(cut, "truncated")))
        return F.struct(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 6).alias("score"), flags.alias("flags"))

    return let(let(F.lower(x), facts), told)

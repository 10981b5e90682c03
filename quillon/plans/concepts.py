"""Queries of the concept rules over captions made of clinical sentences and each document's own text.

Stand-ins: a document is a caption; which names, sentences, sides and values its row holds follows from its id, so answers vary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concepts as K
from .common import table

_NAMES = (
    "effusion", "lung mass", "mass", "CT scan", "left kidney", "pneumothorax", "red box", "upper left region", "region of interest", "disease", "benign lesion", "carcinoma", "liver", "spleen", "kidney", "lung", "high-grade tumor",
    "low-grade tumor", "villous adenoma", "tubular adenoma", "glioma", "necrosis", "no fracture", "cross sectional view", "uncertain: nodule",
)
_SENTENCES = (
    ("No evidence of ", " is seen."), ("There is a possible ", " in the left lung."), ("The ", " is large and suggestive of change."), ("On the right side a ", " shows."), ("Free of ", "; otherwise normal."), ("A ", " and bilateral changes.\nShowing various organs."),
)
_MENTIONS = ("same", "", "same", "absent words", "other", "same")
_SIDES, _STATES, _TYPES = ("left", "", "odd", "unspecified", "bilateral"), ("present", "", "negated", "maybe", "uncertain"), ("finding", "pathology", "modality", "strange", "")


def _pick(k: int, n: int) -> Column:
    return ((F.col("doc_id") * 48271 + 7919 * k) % 65521 % n + 1).cast("int")


def _of(values, k: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _pick(k, len(values)))


def _caption() -> Column:
    parts = []
    for j in range(3):
        parts += [_of([a for a, _ in _SENTENCES], j), _of(_NAMES, 10 + j), _of([b for _, b in _SENTENCES], j), F.lit(" ")]
    return F.concat(*parts, F.coalesce("text", F.lit("")))


def _item(j: int) -> Column:
    """Item j: named as a sentence's name, or another; mentioned as it is, not at all, as something absent, or as another."""
    name = F.when(_pick(20 + j, 3) == 1, _of(_NAMES, 30 + j)).otherwise(_of(_NAMES, 10 + j % 3))
    how = _of(_MENTIONS, 40 + j)
    mention = F.when(how == "same", name).when(how == "other", _of(_NAMES, 10 + (j + 1) % 3)).otherwise(how)
    return F.struct(name.alias("canonical"), _of(_TYPES, 50 + j).alias("type"), _of(_STATES, 60 + j).alias("status"), _of(_SIDES, 70 + j).alias("laterality"), mention.alias("mention"))


def _rows(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", _caption().alias("caption"), F.array(*[_item(j) for j in range(n)]).alias("c"), _of(("CT", "MRI", "pet", "xray chest"), 90).alias("modality"))


def _flat(concepts: Column) -> Column:
    return F.array_join(F.transform(concepts, lambda c: F.concat_ws("/", c["canonical"], c["type"], c["status"], c["laterality"], c["mention"])), "; ")


def concept_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3: answers (prose round a JSON object) parsed against their captions."""
    d = _rows(spark, sf_dir).withColumn("raw", F.concat(F.lit("Here: "), F.to_json(F.struct(F.col("c").alias("concepts"))), F.lit(" done")))
    p = d.select("doc_id", K.parsed(F.col("raw"), F.col("caption")).alias("p"))
    return p.select("doc_id", _flat(F.col("p.concepts")).alias("concepts"), F.array_join("p.repairs", ",").alias("repairs"), K.target(F.col("p.concepts")).alias("target"))


def concept_parse_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the older rules."""
    p = _rows(spark, sf_dir).select("doc_id", K.parsed(F.to_json(F.struct(F.col("c").alias("concepts"))), F.col("caption"), strict=False).alias("p"))
    return p.select("doc_id", _flat(F.col("p.concepts")).alias("concepts"), F.size("p.concepts").cast("long").alias("n"))


def concept_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5, K6: sides and status read from the caption, drop reasons, distinct names."""
    p = _rows(spark, sf_dir).select("doc_id", K.repaired(F.col("c"), F.col("caption")).alias("p"))
    return p.select("doc_id", K.target(F.col("p.concepts"), distinct=False).alias("target"), F.array_join(F.array_sort("p.repairs"), ",").alias("repairs"), F.coalesce("p.error", F.lit("")).alias("error"))


def concept_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that stand near a word of doubt and are nowhere affirmed."""
    d = _rows(spark, sf_dir, 4)
    return d.select("doc_id", F.array_join(F.transform("c", lambda c: K.uncertain_in_context(c, F.col("caption")).cast("int").cast("string")), "").alias("doubted"))


def concept_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: why concepts are no findings, counted."""
    e = _rows(spark, sf_dir).select(F.explode("c").alias("c"))
    return e.groupBy(F.coalesce(K.drop_reason(F.col("c.canonical"), F.col("c.mention")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def concept_audit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: findings of the independent audit, counted."""
    d = _rows(spark, sf_dir).select(K.audit_reasons(F.col("c"), F.col("caption"), F.col("modality")).alias("r"))
    return K.repair_counts(d, "r")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three to eight names a row."""
    d = _rows(spark, sf_dir, 0)
    own = F.transform(F.array(*[_of(_NAMES, 100 + j) for j in range(8)]), lambda n: n)
    return d.select("doc_id", "caption", "modality", F.slice(own, 1, _pick(99, 6) + 2).alias("names"))


def concept_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: flags of each list of names."""
    return _names(spark, sf_dir).select("doc_id", F.array_join(K.audit_flags(F.transform("names", F.lower), F.col("caption")), ",").alias("flags"))


def concept_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each list of names."""
    return _names(spark, sf_dir).select("doc_id", F.array_join(K.violations(F.transform("names", F.lower)), ",").alias("flags"))


def concept_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: denials, oppositions and lists of organs resolved by the caption."""
    r = _names(spark, sf_dir).select("doc_id", K.resolved(F.col("names"), F.col("caption"), F.col("modality")).alias("r"))
    return r.select("doc_id", F.array_join("r.concepts", ";").alias("concepts"), F.array_join("r.repairs", ",").alias("repairs"))


def concept_cap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cap of 6 cuts from lists of 10."""
    return K.cap_report(_rows(spark, sf_dir), "c", "caption", "modality", 6, 10)


def concept_sample_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of 100 rows in hash order."""
    return K.sample_audit(_rows(spark, sf_dir, 6), "doc_id", "c", "caption", 100)


def concept_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a row's metadata that leak nothing."""
    keys = F.array_distinct(F.array(F.lit("source"), _of(("Caption", "raw", "lang", "raw_response"), 1), _of(("source_caption", "page", "RAW", "license"), 2)))
    d = table(spark, sf_dir, "documents").select("doc_id", F.map_from_arrays(keys, F.transform(keys, lambda k: F.lit("v"))).alias("meta"))
    return d.select("doc_id", F.array_join(F.array_sort(F.map_keys(K.scrub(F.col("meta")))), ",").alias("keys"))


_WORDS = tuple(K.ORDINALS)


def concept_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image that a question names last, of one to four; the second where it names none."""
    q = F.concat(F.lit("See the "), _of(_WORDS, 1), _of((" Image", " picture", " image and"), 2), F.lit(" or the "), _of(_WORDS, 3), _of((" image.", " view.", " imaged."), 4))
    return table(spark, sf_dir, "documents").select("doc_id", K.ordinal_image(q, _pick(5, 4), F.lit(1)).alias("image"))


# ---- the same in SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _sql_of(values, k: int) -> str:
    return f"({_sql_list(values)})[(doc_id * 48271 + {7919 * k}) % 65521 % {len(values)} + 1]"


_SQL_CAPTION = " || ".join(f"{_sql_of([a for a, _ in _SENTENCES], j)} || {_sql_of(_NAMES, 10 + j)} || {_sql_of([b for _, b in _SENTENCES], j)} || ' '" for j in range(3)) + " || coalesce(text, '')"


def _sql_item(j: int) -> str:
    name = f"case when (doc_id * 48271 + {7919 * (20 + j)}) % 65521 % 3 = 0 then {_sql_of(_NAMES, 30 + j)} else {_sql_of(_NAMES, 10 + j % 3)} end"
    how = _sql_of(_MENTIONS, 40 + j)
    mention = f"case {how} when 'same' then {name} when 'other' then {_sql_of(_NAMES, 10 + (j + 1) % 3)} else {how} end"
    return f"{{'can': {name}, 'typ': {_sql_of(_TYPES, 50 + j)}, 'st': {_sql_of(_STATES, 60 + j)}, 'lat': {_sql_of(_SIDES, 70 + j)}, 'men': {mention}}}"


def _sql_rows(n: int = 10) -> str:
    """d: captions; e: one row an item, in order i."""
    return f"""d as (select doc_id, {_SQL_CAPTION} caption, [{', '.join(_sql_item(j) for j in range(n))}] c, {_sql_of(('CT', 'MRI', 'pet', 'xray chest'), 90)} modality from documents),
        e as (select doc_id, caption, modality, unnest(c, recursive := true), unnest(range(len(c))) i from d)"""


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _near(s: str, m: str, cues: str, before: int, after: int) -> str:
    return rf"({m} <> '' and (regexp_matches({s}, '\b(?:{cues})(?: [a-z0-9]+){{0,{before}}} ' || {m} || '\b') or regexp_matches({s}, '\b' || {m} || '(?: [a-z0-9]+){{0,{after}}} (?:{cues})\b')))"


def _sents(c: str) -> str:
    """Sentences: cut behind . ! ? ; and white space, and at line ends."""
    return rf"string_split_regex(regexp_replace({c}, '([.!?;])\s+', '\1' || chr(2), 'g'), '\n+|' || chr(2))"


_SQ = lambda x: rf"regexp_replace({x}, '([\\.\[\]{{}}()*+?^$|])', '\\\1', 'g')"
_ALIAS = "case lower(can) " + " ".join(f"when {_q(k)} then {_q(v)}" for k, v in K.ALIASES.items()) + " end"
_PARSE = f"""{_sql_rows()},
  f as (select *, lower(regexp_replace(caption, '\\s+', ' ', 'g')) txt, list_distinct(list_filter(string_split_regex(lower(can), '[^a-z0-9]+'), lambda w: length(w) > 2)) cw, list_distinct(list_filter(string_split_regex(lower(men), '[^a-z0-9]+'), lambda w: length(w) > 2)) mw,
    coalesce(nullif(typ, ''), 'finding') typ0, coalesce(nullif(st, ''), 'present') st0, coalesce(nullif(lat, ''), 'unspecified') lat0 from e),
  g as (select *, contains(txt, lower(can)) hc, men <> '' and contains(txt, lower(men)) hm from f),
  w as (select *, case when regexp_matches(lower(can), {_q(K.OVERLAY)}) then 'drop_artifact' when men = '' and hc then 'missing_mention_canonical_fallback' when men = '' then 'drop_missing_mention' when not hm and hc then 'canonical_evidence_fallback'
    when not hm then 'drop_unsupported_mention' when hc and not contains(lower(men), lower(can)) then 'canonical_evidence_preferred' when not hc and (len(cw) = 0 or len(list_intersect(cw, mw)) < greatest(1, (len(cw) + 1) // 2)) then 'drop_unsupported_canonical' end why from g),
  m as (select *, case when why is not null and not starts_with(why, 'drop_') then can else men end m0 from w),
  l as (select *, substring(txt, greatest(strpos(txt, lower(m0)) - 51, 0)::bigint + 1, (strpos(txt, lower(m0)) - 1 + length(m0) + 10 - greatest(strpos(txt, lower(m0)) - 51, 0))::bigint) loc, list_contains({_sql_list(K.TYPES)}, typ0) tk, list_contains({_sql_list(K.STATES)}, st0) sk, list_contains({_sql_list(K.SIDES)}, lat0) lk from m),
  n as (select *, case when tk then typ0 else 'finding' end typ1, case when sk then st0 else 'present' end st1, case when lk then lat0 else 'unspecified' end lat1, regexp_matches(loc, {_q(K.DENIED)} || {_SQ('lower(m0)')}) dn, regexp_matches(loc, {_q(K.DOUBTED)} || {_SQ('lower(m0)')}) db from l),
  o as (select *, coalesce({_ALIAS}, can) can1, case when dn then 'negated' when st1 = 'present' and db then 'uncertain' else st1 end st2, starts_with(coalesce(why, ''), 'drop_') gone from n),
  p as (select *, case when not gone then row_number() over (partition by doc_id, gone, lower(can1), typ1, st2, lat1 order by i) end rn from o),
  q as (select *, sum((rn = 1)::int) over (partition by doc_id order by i) kept_so_far from p),
  z as (select * from q where coalesce(kept_so_far, 0) < 8 or (kept_so_far = 8 and rn = 1 and not gone))"""
_LOG = """case when gone then [why] else list_filter([why, case when not tk then 'repair_type' end, case when not sk then 'repair_status' end, case when not lk then 'repair_laterality' end, case when dn and st1 <> 'negated' then 'repair_negation' when st1 = 'present' and db then 'repair_uncertainty' end,
  case when can1 <> can or lower(can) in (select unnest([{}])) then 'normalize_synonym' end, case when rn > 1 then 'drop_duplicate' end], lambda x: x is not null) end""".format(", ".join(map(_q, K.ALIASES)))
_ONE = "case when st2 <> 'present' then st2 || ': ' else '' end || case when lat1 <> 'unspecified' and not contains(lower(can1), lat1) then lat1 || ' ' else '' end || can1"

_REPAIR = f"""{_sql_rows()},
  f as (select *, coalesce(nullif(men, ''), can) m1, coalesce(nullif(st, ''), 'present') st0, coalesce(nullif(lat, ''), 'unspecified') lat0 from e),
  g as (select *, {_norm('m1')} m, {_norm('can')} k, coalesce(list_filter(list_transform({_sents('caption')}, lambda s: {_norm('s')}), lambda s: contains(s, {_norm('m1')}))[1], '') s from f),
  h as (select *, case when s = '' then [] else string_split(trim(split_part(s, m, 1)), ' ')[-4:] end ah, lat0 in ('left', 'right', 'bilateral', 'midline', 'unspecified') kn from g),
  x as (select *, case when kn and lat0 <> 'unspecified' then null when contains(m, 'bilateral') or (contains(m, 'left') and contains(m, 'right')) then 'bilateral' when regexp_matches(m, '\\bleft\\b') then 'left' when regexp_matches(m, '\\bright\\b') then 'right'
    when list_contains(ah, 'bilateral') or (list_contains(ah, 'left') and list_contains(ah, 'right')) then 'bilateral' when list_contains(ah, 'left') then 'left' when list_contains(ah, 'right') then 'right' end side,
    case when {_near('s', 'm', K.DENIAL_WORDS, 4, 2)} then 'negated' when {_near('s', 'm', K.DOUBT_WORDS, 6, 5)} then 'uncertain' when list_contains({_sql_list(K.STATES)}, st0) then st0 else 'present' end st2,
    case when list_contains({_sql_list(K.GENERIC)}, k) then 'drop_generic_exact_v3' when regexp_matches(k, {_q(K.POSITION)}) then 'drop_position_template_v3' when list_contains({_sql_list(K.NONCLINICAL)}, k) then 'drop_nonclinical_exact_v3'
      when regexp_matches(k, {_q(K.ANNOTATION)}) or regexp_matches({_norm('m1')}, {_q(K.ANNOTATION)}) then 'drop_roi_annotation_v3' end drp from h),
  y as (select *, coalesce(side, case when kn then lat0 else 'unspecified' end) lat1, case when drp is null then row_number() over (partition by doc_id, drp is null, k order by i) end rn from x),
  z as (select *, sum((rn = 1)::int) over (partition by doc_id order by i) sofar from y)"""
_REPAIR_LOG = "list_filter([case when not kn then 'normalize_laterality_v3' end, case when side is not null then 'infer_laterality_v3' end, case when st2 <> st0 then 'normalize_' || st2 || '_v3' end, drp, case when rn > 1 and sofar < 8 then 'exact_normalized_dedup_v3' end], lambda x: x is not null)"

_LISTS = f"n as (select doc_id, {_SQL_CAPTION} caption, {_sql_of(('CT', 'MRI', 'pet', 'xray chest'), 90)} modality, ([{', '.join(_sql_of(_NAMES, 100 + j) for j in range(8))}])[1:((doc_id * 48271 + {7919 * 99}) % 65521 % 6 + 3)::bigint] names from documents), l as (select doc_id, caption, modality, list_transform(names, lambda x: lower(x)) c from n)"


def _has(terms, c: str = "c") -> str:
    return f"list_filter({c}, lambda x: " + " or ".join(f"contains(x, {_q(t)})" for t in terms) + ")"


def _opposed_sql(pairs) -> str:
    return "(" + " or ".join(f"(len({_has(a)}) > 0 and len({_has(b)}) > 0)" for a, b in pairs) + ")"


_ORGANS = f"len(list_filter(c, lambda x: list_contains({_sql_list(K.ORGANS)}, x)))"
_MANY = f"({_ORGANS} >= 4 or (len(c) = 8 and {_ORGANS} >= 3))"
_TOK = lambda x: f"list_distinct(list_filter(string_split_regex({x}, '[^a-z0-9]+'), lambda w: w <> ''))"
_OWN = lambda x: f"list_filter({_TOK(x)}, lambda w: not list_contains({_sql_list(K.UNSPECIFIC)}, w))"
_TXT = "lower(trim(trim(regexp_replace(caption, '\\s+', ' ', 'g')), ' ;,.'))"
_DIAG = f"list_filter(c, lambda x: regexp_matches(x, {_q(K.DIAGNOSES)}))"


def _flags(pairs) -> str:
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"case when {c} then {_q(n)} end" for n, c in pairs) + "], lambda x: x is not null)), ',')"


_ANY = lambda p: f"len(list_filter(c, lambda x: regexp_matches(x, {_q(p)}))) > 0"
_AUDIT = f"""with {_LISTS}, t as (select *, {_TXT} txt, {_DIAG} dg from l),
  u as (select doc_id, list_filter(dg, lambda x: len({_OWN('x')}) > 0 and len(list_filter(dg, lambda y: y <> x and list_has_any({_OWN('x')}, {_OWN('y')}))) = 0) alone,
    len(list_filter(dg, lambda x: not list_contains({_sql_list(K.VAGUE)}, x) and not contains(txt, x) and len(list_filter({_OWN('x')}, lambda w: length(w) >= 5)) > 0 and len(list_filter({_OWN('x')}, lambda w: length(w) >= 5 and contains(txt, w))) = 0)) > 0 uns,
    len(list_filter(c, lambda a: len(list_filter(c, lambda b: list_has_all({_TOK('b')}, {_TOK('a')}) and len({_TOK('b')}) > len({_TOK('a')}) and list_has_any({_TOK('a')}, {_sql_list(K.HEADS)}))) > 0)) > 0 nest, c from t)
  select doc_id, {_flags([('semantic_duplicate', 'len(c) <> len(list_distinct(c))'), ('uncertain_prefix', "len(list_filter(c, lambda x: starts_with(x, 'uncertain:'))) > 0"), ('negated_concept', _ANY(K.NEGATED)), ('geometric_view_artifact', _ANY(K.GEOMETRIC)),
    ('mutually_exclusive_diagnosis', _opposed_sql(K.OPPOSITES)), ('parent_child_duplicate', '(nest or ' + ' or '.join(f"list_has_all(c, [{_q(a)}, {_q(b)}])" for a, b in K.RELATED) + ')'),
    ('mutually_exclusive_differential', "(list_has_all(c, ['villous adenoma', 'tubular adenoma']) or (list_contains(c, 'granuloma') and list_has_any(c, ['nerve sheath tumor', 'neurofibroma'])) or len(alone) >= 3)"), ('background_organ_enumeration', _MANY),
    ('generic_only', f"(len(c) > 0 and len(list_filter(c, lambda x: not list_contains({_sql_list(K.VAGUE)}, x))) = 0)"), ('cap8_review', 'len(c) = 8'), ('unsupported_specific_diagnosis', 'uns'), ('unsupported_or_over-specific_concept', 'uns')])} flags from u"""
_CHILD = " or ".join(rf"(list_contains(c, '{w}') and len(list_filter(c, lambda x: x <> '{w}' and regexp_matches(x, '\b{w}\b'))) > 0)" for w in ("lesion", "mass", "carcinoma"))
_VIOLATIONS = f"""with {_LISTS} select doc_id, {_flags([('uncertain_prefix', "len(list_filter(c, lambda x: starts_with(x, 'uncertain:'))) > 0"), ('negated_concept', _ANY(K.NEGATED)),
    ('roi_or_generic_artifact', f"(len(list_filter(c, lambda x: regexp_matches(x, {_q(K.FORBIDDEN)}) or list_contains({_sql_list(K.VIOLATING)}, x))) > 0)"), ('mutually_exclusive_concepts', _opposed_sql(K.RESOLVED_OPPOSITES)), ('parent_child_duplicate', '(' + _CHILD + ')'), ('background_organ_enumeration', _MANY)])} flags from l"""


def _times(terms) -> str:
    return "(" + " + ".join(f"(length(txt) - length(replace(txt, {_q(t)}, ''))) // {len(t)}" for t in terms) + ")"


def _resolve_sql() -> str:
    """Each step is a query over the one before it."""
    dup = "list_filter(list_transform(names, lambda x: lower(trim(trim(x), ' ;,.'))), lambda x: x <> '')"
    deniable = f"(list_contains({_sql_list(K.DENIABLE)}, x) or regexp_matches(x, {_q(K.MARKERS)}))"
    steps = [
        f"list_filter(c, lambda x: not regexp_matches(x, {_q(K.NEGATED)}))",
        f"list_filter(c, lambda x: not ({deniable} and regexp_matches(txt, {_q(K.NEGATED)} || '.{{0,' || (96 - length(x))::varchar || '}}\\b' || {_SQ('x')} || '\\b')))",
    ]
    for a, b in K.RESOLVED_OPPOSITES:
        both = f"len({_has(a)}) > 0 and len({_has(b)}) > 0"
        gone = f"case when {_times(a)} > {_times(b)} then {_has(b)} when {_times(b)} > {_times(a)} then {_has(a)} else {_has(a)} || {_has(b)} end"
        steps.append(f"case when {both} then list_filter(c, lambda y: not list_contains({gone}, y)) else c end")
    rest = f"list_filter(c, lambda x: not list_contains({_sql_list(K.ORGANS)}, x))"
    steps.append(f"case when {_MANY} and len({rest}) > 0 then {rest} else c end")
    idle = f"(list_contains({_sql_list(K.ORGANS)}, x) and (length(txt) - length(replace(txt, x, ''))) // length(x) = 1 and contains(txt, 'showing various organs') and not regexp_matches(txt, '{K.UPTAKE}[^.]*\\b' || x || '\\b') and not regexp_matches(txt, '\\b' || x || '\\b[^.]*{K.UPTAKE}'))"
    pet = f"list_filter(c, lambda x: not {idle})"
    steps.append(f"case when lower(modality) = 'pet' and len({pet}) > 0 then {pet} else c end")
    why = ["remove_explicitly_negated_concept", "remove_caption_negated_positive_concept", *["resolve_caption_internal_contradiction"] * 4, "remove_obvious_background_organ_enumeration", "remove_pet_single_mention_background_organ"]
    sql = f"with {_LISTS}, s0 as (select doc_id, modality, {_TXT} txt, list_filter({dup}, lambda x, i: list_position({dup}, x) = i) c, []::varchar[] r from n)"
    for i, (step, name) in enumerate(zip(steps, why, strict=True)):
        sql += f", t{i} as (select *, {step} c1 from s{i}), s{i + 1} as (select doc_id, modality, txt, c1 c, case when len(c1) <> len(c) and not list_contains(r, '{name}') then r || ['{name}'] else r end r from t{i})"
    return sql + f" select doc_id, array_to_string(c, ';') concepts, array_to_string(r, ',') repairs from s{len(steps)}"


_REASONS = f"""f as (select *, coalesce(nullif(men, ''), can) m1 from e),
  g as (select *, {_norm('m1')} m, {_norm('can')} k, {_norm('caption')} txt, {_norm('modality')} md, coalesce(list_filter(list_transform({_sents('caption')}, lambda s: {_norm('s')}), lambda s: contains(s, {_norm('m1')}))[1], '') s from f),
  h as (select *, list_filter([case when regexp_matches(k, {_q(K.POSITION)}) then 'pure_positional_concept' end, case when regexp_matches(k, {_q(K.ANNOTATION)}) or regexp_matches(m, {_q(K.ANNOTATION)}) then 'annotation_or_roi_concept' end,
    case when list_contains({_sql_list(K.AUDIT_GENERIC)}, k) then 'generic_nonclinical_concept' end, case when m = '' or not contains(txt, m) then 'caption_support_failure' end, case when {_near('s', 'm', K.DOUBT_WORDS, 6, 5)} and st = 'present' then 'uncertainty_cue_inconsistency' end,
    case when {_near('s', 'm', K.DENIAL_WORDS, 4, 2)} and st <> 'negated' then 'negation_inconsistency' end, {', '.join(f"case when typ = 'modality' and starts_with(md, {_q(a)}) and not list_contains({_sql_list(b)}, k) and not contains(txt, m) then 'modality_anatomy_contradiction' end" for a, b in K.MODALITIES.items())}], lambda x: x is not null) r from g)"""
_DUPES = " union all ".join(f"select 'synonym_duplicate' reason, greatest(count(distinct k) - 1, 0) n from g where k in ({', '.join(map(_q, s))}) group by doc_id" for s in K.SAME_NAMES)
_DOUBT = r"(?i)\b(?:" + K.DOUBT_WORDS.replace(" ", r"\s+") + r")\b"
_UNC = f"""with {_sql_rows(4)}, f as (select *, {_norm("coalesce(nullif(men, ''), can)")} m, {_sents('caption')} ss from e), g as (select *, list_filter(ss, lambda s: contains({_norm('s')}, m)) mine from f)
  select doc_id, string_agg((typ in ('finding', 'pathology') and st <> 'negated' and len(list_filter(mine, lambda s: {_near(_norm('s'), 'm', K.DOUBT_WORDS, 6, 5)})) > 0 and len(list_filter(mine, lambda s: regexp_matches(s, {_q(K.AFFIRMED)}) and not regexp_matches(s, {_q(_DOUBT)}))) = 0)::int::varchar, '' order by i) doubted from g group by doc_id"""

QUERIES = {
    "concept_parse": (concept_parse, f"""with {_PARSE}, t as (select doc_id, i, {_ONE} one from z where rn = 1), tt as (select doc_id, i, one, row_number() over (partition by doc_id, lower(one) order by i) k from t)
        select d.doc_id, coalesce((select string_agg(concat_ws('/', can1, typ1, st2, lat1, m0), '; ' order by i) from z where z.doc_id = d.doc_id and rn = 1), '') concepts,
          coalesce((select string_agg(w, ',' order by i, j) from (select doc_id, i, unnest({_LOG}) w, generate_subscripts({_LOG}, 1) j from z) b where b.doc_id = d.doc_id), '') repairs,
          coalesce((select string_agg(one, '; ' order by i) from tt where tt.doc_id = d.doc_id and k = 1), '') target from d"""),
    "concept_parse_plain": (concept_parse_plain, f"""with {_sql_rows()}, f as (select *, lower(regexp_replace(caption, '\\s+', ' ', 'g')) txt from e),
        g as (select *, contains(txt, lower(can)) hc, men <> '' and contains(txt, lower(men)) hm, case when typ in {tuple(K.TYPES)} then typ else 'finding' end t1, case when st in {K.STATES} then st else 'present' end s1, case when lat in {K.SIDES} then lat else 'unspecified' end l1 from f),
        h as (select *, row_number() over (partition by doc_id, lower(can), t1, s1, l1 order by i) rn from g where hc or hm)
        select d.doc_id, coalesce(string_agg(concat_ws('/', can, t1, s1, l1, case when hm then men else can end), '; ' order by i), '') concepts, count(rn) n from d left join (select * from h where rn = 1) h using (doc_id) group by d.doc_id"""),
    "concept_repair": (concept_repair, f"""with {_REPAIR}, k as (select doc_id, string_agg(case when st2 <> 'present' then st2 || ': ' else '' end || case when lat1 <> 'unspecified' and not regexp_matches(lower(can), '\\b' || lat1 || '\\b') then lat1 || ' ' else '' end || can, '; ' order by i) target from z where rn = 1 and sofar <= 8 group by 1),
        r as (select doc_id, string_agg(w, ',' order by w) repairs from (select doc_id, unnest({_REPAIR_LOG}) w from z) group by 1)
        select d.doc_id, coalesce(target, '') target, coalesce(repairs, '') repairs, case when target is null then 'empty_after_concept_v3_repair' else '' end error from d left join k using (doc_id) left join r using (doc_id)"""),
    "concept_uncertain": (concept_uncertain, _UNC),
    "concept_drop_reasons": (concept_drop_reasons, f"with {_REPAIR} select coalesce(case when drp = 'drop_roi_annotation_v3' and not regexp_matches(k, {_q(K.ANNOTATION)}) and not regexp_matches({_norm('men')}, {_q(K.ANNOTATION)}) then null else drp end, 'kept') reason, count(*) n from x group by 1"),
    "concept_audit_reasons": (concept_audit_reasons, f"with {_sql_rows()}, {_REASONS} select reason, sum(n)::bigint n from (select unnest(r) reason, 1 n from h union all {_DUPES} union all select 'exact_duplicate', count(*) - count(distinct k) from g where k <> '' group by doc_id) where n > 0 group by 1"),
    "concept_audit": (concept_audit, _AUDIT),
    "concept_violations": (concept_violations, _VIOLATIONS),
    "concept_resolve": (concept_resolve, _resolve_sql()),
    "concept_cap_report": (concept_cap_report, f"""with {_sql_rows()}, {_REASONS}, x as (select doc_id, contains(txt, {_norm('men')}) sup, contains(txt, {_norm('men')}) and len(r) = 0 use from h where i >= 6), y as (select doc_id, bool_or(use) u from x group by 1)
        select count(distinct doc_id) n, count(*) n_extra, count(*) filter (sup) n_supported, count(*) filter (use) n_useful, (select count(*) filter (u) from y) n_rows_useful, (select count(*) filter (u) from y) < 0.2 * count(distinct doc_id) keep_cap from x"""),
    "concept_sample_audit": (concept_sample_audit, f"""with {_sql_rows(6)}, s as (select doc_id from d order by sha256('42|audit|' || doc_id::varchar), doc_id limit 100), f as (select * from e join s using (doc_id)),
        g as (select (select count(*) from s) n, count(*) filter (not contains(lower(caption), lower(men)))::bigint unsupported, (count(*) - count(distinct (doc_id, lower(can), typ, st, lat)))::bigint repeated, count(*) filter (st = 'present' and regexp_matches(lower(caption), {_q(K.DENIED)} || {_SQ('lower(men)')}))::bigint denied from f)
        select *, n > 0 and unsupported = 0 and repeated = 0 and denied = 0 passes from g"""),
    "concept_scrub": (concept_scrub, f"select doc_id, array_to_string(list_sort(list_distinct(list_filter(['source', {_sql_of(('Caption', 'raw', 'lang', 'raw_response'), 1)}, {_sql_of(('source_caption', 'page', 'RAW', 'license'), 2)}], lambda k: lower(k) not in ('caption', 'source_caption', 'raw', 'raw_response')))), ',') keys from documents"),
    "concept_ordinals": (concept_ordinals, f"""with q as (select doc_id, lower('See the ' || {_sql_of(_WORDS, 1)} || {_sql_of((' Image', ' picture', ' image and'), 2)} || ' or the ' || {_sql_of(_WORDS, 3)} || {_sql_of((' image.', ' view.', ' imaged.'), 4)}) q, ((doc_id * 48271 + {7919 * 5}) % 65521 % 4 + 1)::int n from documents),
        f as (select *, regexp_extract_all(q, '\\b({'|'.join(_WORDS)}) image\\b', 1) w from q) select doc_id, least(coalesce(case w[-1] {' '.join(f"when '{k}' then {v}" for k, v in K.ORDINALS.items())} end, 1), n - 1)::int image from f"""),
}

"""Personal data by weak supervision: patterns propose spans, labelers vote on them, expectation-maximisation weighs the
labelers, and a logistic model trained on its posteriors decides on the spans beyond the fixed kinds.

Everything that touches rows is DataFrame functions; the driver sees counts by vote pattern, at most 9 * 3^5 rows.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, table

#: Fixed values. A pattern for each kind, the first four being the contract's. Repetitions that nothing can follow are
#: possessive, and a match begins where the one before ended or where no earlier character could begin it: the matches are
#: the same and take linear time. The guard is a cheap test that texts without a match mostly fail.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "email_like": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}){1,5}", r"[\[(]at[\])]"),
    "phone_local": (r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]{4}"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    "person": (r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}{1,20}\.?\x20\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\p{Ll}{1,20})?(?!\p{L})", r"\p{Ll}\.?\x20\p{Lu}\p{Ll}"),
}
BASE = ("email", "ip", "card", "phone")
LABELERS = ("form", "gazetteer", "near", "against", "edges")
#: Forms of address and first names that speak for a person, and words that begin no name.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora Don Doña"
NAMES = (
    "James Mary John Linda Robert Susan Michael Karen David Sarah Thomas Anna Peter Maria Hans Pierre Marie Jean Carlos Juan William Elizabeth "
    "Richard Jennifer Joseph Patricia Charles Laura Daniel Emma Paul Julia Mark Sophie Klaus Petra Wolfgang Monika Jürgen Sabine Stefan Claudia "
    "François Isabelle Luc Claire Antoine Camille José Carmen Antonio Lucía Miguel Elena Pablo Rosa Andrew Alice George Helen Martin Eva"
)
NO_NAMES = (
    "The A An In On At Of For And But This That These It He She We They If When With From To By As Der Die Das Den Dem Ein Eine Und Im Am Zu Von "
    "Mit Für Auf Ist Es Sie Er Wir Le La Les Un Une Des Du Et En Dans Pour Par Sur Il Elle El Los Las Una Y Por Con Para No Se Su New North South"
)
#: Pseudo-counts that draw a labeler's rates on one kind towards its rates on all.
SHRINK = 20
#: Words that speak for a kind when they stand shortly before, and words that speak against any.
NEAR = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": r"\bip\b|host|server|addr|login", "card": "card|visa|master|amex|karte|carte|tarjeta|pay",
    "phone": "phone|tel|call|fax|mobile|handy|appel", "email_like": "mail|contact|write|kontakt|correo|courriel", "phone_local": "phone|tel|call|fax|mobile|handy|appel",
    "ssn": "ssn|social|security|tax", "iban": "iban|account|bank|konto|compte|cuenta", "person": "name|contact|dear|signed|author|patient",
}
AGAINST = r"version|\bv\.?$|section|chapter|isbn|issn|order|invoice|build|release|page|figure|table|sample"
FEATURES = ("long", "digit", "upper", *LABELERS, *(f"is_{k}" for k in KINDS))


def _spans(text: str, kind: str) -> str:
    """SQL for the matches of a kind as array<struct<kind, start, end, value>>: gaps between matches give the positions."""
    pattern, guard = KINDS[kind]
    gaps, found = f"split({text}, r'{pattern}', -1)", f"regexp_extract_all({text}, r'{pattern}', 0)"
    none = "cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)"
    return f"""case when {text} rlike r'{guard}' then aggregate(
        zip_with({gaps}, {found}, (g, m) -> named_struct('g', g, 'm', m)), named_struct('at', 0, 'out', {none}),
        (s, x) -> named_struct('at', s.at + length(x.g) + coalesce(length(x.m), 0), 'out', if(x.m is null, s.out, concat(s.out, array(
            named_struct('kind', '{kind}', 'start', s.at + length(x.g), 'end', s.at + length(x.g) + length(x.m), 'value', x.m))))),
        s -> s.out) else {none} end"""


def _luhn(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '')"
    digit = f"cast(substr(reverse({d}), i, 1) as int)"
    double = f"if(i % 2 = 1, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))"
    return f"(case when length({d}) between 13 and 19 then aggregate(sequence(1, length({d})), 0, (s, i) -> s + {double}) % 10 = 0 else false end)"


VALID = {
    "email": "true",
    "ip": r"forall(split(x.value, r'\.'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    "card": _luhn("x.value"),
    "phone": "length(regexp_replace(x.value, '[^0-9]', '')) between 9 and 15",
}


def _votes(text: str) -> dict[str, str]:
    """SQL for each labeler's vote on the candidate x: 1 for, 0 against, -1 for none."""
    before = f"lower(substr({text}, greatest(x.start - 39, 1), least(x.start, 40)))"
    last, after = f"substr({text}, greatest(x.start, 1), least(x.start, 1))", f"substr({text}, x.end + 1, 1)"
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    by_kind = lambda table_: "case x.kind " + " ".join(f"when '{k}' then {v}" for k, v in table_.items()) + " else -1 end"
    yes = lambda test: f"if({test}, 1, 0)"
    any_of = lambda words: words.replace(" ", "|")
    return {
        "form": by_kind({
            "email": yes(r"x.value rlike r'^[A-Za-z0-9][^@]{0,63}@[^@]{1,250}\.[A-Za-z]{2,24}$' and not contains(x.value, '..')"), "ip": yes("x.value rlike '^[1-9]'"),
            "card": yes("x.value rlike '^[2-6]'"), "phone": yes(f"length({digits}) >= 10"), "email_like": yes(r"x.value rlike r'[A-Za-z]{2,24}$'"),
            "phone_local": yes(r"x.value rlike r'^\(?[2-9]'"), "ssn": yes("not x.value rlike '^(000|666|9)|-00-|-0000$'"),
            "iban": yes("length(regexp_replace(x.value, ' ', '')) between 15 and 34 and x.value rlike '[0-9]{4}'"),
            "person": rf"if(x.value rlike r'(^| )({any_of(NO_NAMES)})( |$)' or not x.value rlike r'^\p{{Lu}}\p{{Ll}}{{1,11}}\.? \p{{Lu}}\p{{Ll}}{{2,14}}', 0, -1)",
        }),
        "gazetteer": by_kind({
            "email": r"if(x.value rlike r'(?i)\.(com|org|net|edu|de|fr|es|uk|io)$', 1, -1)", "ip": "if(x.value rlike '^(10|127|172|192)[.]', 1, -1)", "card": "if(x.value rlike '^(4|5[1-5]|3[47]|6011|62)', 1, -1)",
            "phone": r"if(x.value rlike r'^\+(1|33|34|44|49|39|41|43|7|81|86|91)', 1, -1)", "email_like": r"if(x.value rlike r'(?i)(com|org|net|edu|de|fr|es|uk)$', 1, -1)",
            "phone_local": r"if(x.value rlike r'555[ .-]', 1, -1)", "ssn": "-1", "iban": yes("x.value rlike '^(DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|LU|DK|SE|NO|FI|PL)'"),
            "person": f"case when x.value rlike r'^({any_of(TITLES)})\\.? ' then 1 when x.value rlike r'^({any_of(NAMES)}) ' then 1 else 0 end",
        }),
        "near": by_kind({k: f"if({before} rlike r'{w}', 1, -1)" for k, w in NEAR.items()}),
        "against": f"if({before} rlike r'{AGAINST}', 0, -1)",
        "edges": "case when x.kind = 'person' then -1 else " + yes(rf"not {last} rlike r'[\p{{L}}\p{{N}}_/=.-]' and not {after} rlike r'[\p{{L}}\p{{N}}_/=]'") + " end",
    }


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 100) -> tuple[dict, dict, dict]:
    """Expectation-maximisation over (kind, votes, count): the share of true spans by kind and, by labeler and kind, how often
    it votes for a true and for a false span when it votes. On kinds with few candidates a labeler's rates are drawn to those
    it has on all; pseudo-counts keep labelers better than chance at the outset. Returns the posterior of every
    (kind, votes), the (hit, false alarm) rates of every (labeler, kind) and the shares."""
    kinds, labelers = sorted({k for k, _, _ in patterns}), range(len(patterns[0][1]) if patterns else 0)
    prior, rate = {k: 0.5 for k in kinds}, {(j, k): (0.8, 0.3) for j in labelers for k in kinds}
    post: dict = {}
    for _ in range(rounds):
        for kind, votes, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for j, v in enumerate(votes):
                hit, alarm = rate[j, kind]
                odds += 0 if v < 0 else math.log(hit / alarm) if v else math.log((1 - hit) / (1 - alarm))
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in kinds:
            rows = [(post[k, v], n) for k, v, n in patterns if k == kind]
            prior[kind] = (sum(p * n for p, n in rows) + 5) / (sum(n for _, n in rows) + 10)
        for j in labelers:
            # Of each kind: true and false spans voted on, and votes for them.
            sums = {k: [0.0] * 4 for k in kinds}
            for kind, votes, n in patterns:
                if votes[j] >= 0:
                    p = post[kind, votes]
                    for at, x in enumerate((p, 1 - p, p * votes[j], (1 - p) * votes[j])):
                        sums[kind][at] += x * n
            true, false, hits, alarms = (sum(s[at] for s in sums.values()) for at in range(4))
            hit, alarm = (hits + 8) / (true + 10), (alarms + 3) / (false + 10)
            for k, (true, false, hits, alarms) in sums.items():
                rate[j, k] = (hits + SHRINK * hit) / (true + SHRINK), (alarms + SHRINK * alarm) / (false + SHRINK)
    return post, rate, prior


def _train(candidates: DataFrame) -> tuple[dict, float] | None:
    """Coefficients by feature and intercept of the span classifier, from candidates(x: the candidate's struct)."""
    names = ["kind", *LABELERS]
    counted = candidates.groupBy(*[F.col(f"x.{c}").alias(c) for c in names]).count().collect()
    if not counted:
        return None
    post, _, _ = estimate([(r["kind"], tuple(r[c] for c in LABELERS), r["count"]) for r in sorted(counted, key=lambda r: tuple(r[c] for c in names))])
    spark = candidates.sparkSession
    known = F.broadcast(spark.createDataFrame([(k, *v, p) for (k, v), p in post.items()], "kind string, " + ", ".join(f"{c} int" for c in LABELERS) + ", p double"))
    shape = ["long", "digit", "upper"]
    rows = candidates.select("x.*").groupBy(*names, *shape).agg(F.count("*").cast("double").alias("n")).join(known, names)
    halves = [rows.withColumns({"label": F.lit(float(y)), "weight": F.col("n") * (F.col("p") if y else 1 - F.col("p"))}) for y in (0, 1)]
    ready = halves[0].unionByName(halves[1]).where("weight > 0").withColumns({f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS})
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ready)
    fitted = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30).fit(ready)
    return dict(zip(FEATURES, map(float, fitted.coefficients))), float(fitted.intercept)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added).

    The four base kinds are found by pattern and check and always kept. Candidates of the other kinds that overlap no base
    span are added where the classifier gives them at least the threshold; of those that overlap each other the first one
    stays, the longer one of two that begin together. Candidates of all kinds take part in the votes.

    Null texts count as empty; ids may be null or repeat, each row having its own result; other columns are ignored; an
    empty table gives no rows; without candidates nothing is learned or added.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = {k: F.expr(f"filter({_spans('t', k)}, x -> {VALID.get(k, 'true')})") for k in KINDS}
    votes = ", ".join(f"'{k}', {v}" for k, v in _votes("t").items())
    shape = (
        "'long', least(floor(log2(length(x.value) + 1)), 8D), 'digit', floor(4 * length(regexp_replace(x.value, '[^0-9]', '')) / length(x.value)) / 4D, "
        "'upper', floor(4 * length(regexp_replace(x.value, '[^A-Z]', '')) / length(x.value)) / 4D"
    )
    voted = F.expr(f"transform(c, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, {votes}, {shape}))")
    rows = rows.withColumn("c", F.concat(*found.values())).select("doc_id", voted.alias("c"))
    rows = save(rows, "candidates")
    model = _train(rows.where("size(c) > 0").select(F.explode("c").alias("x")))
    base = F.expr("filter(c, x -> x.kind in (%s))" % ", ".join(f"'{k}'" for k in BASE))
    rows = rows.withColumn("base", base)
    if model:
        weight, intercept = model
        logit = " + ".join([repr(intercept), *(f"({weight[k]!r}) * x.{k}" for k in ("long", "digit", "upper", *LABELERS))])
        logit += " + case x.kind " + " ".join(f"when '{k}' then ({weight[f'is_{k}']!r})" for k in KINDS) + " else 0D end"
        other = ", ".join(f"'{k}'" for k in KINDS if k not in BASE)
        likely = f"filter(c, x -> x.kind in ({other}) and {logit} >= {math.log(threshold / (1 - threshold))!r} and not exists(base, b -> b.start < x.end and x.start < b.end))"
        ordered = f"array_sort({likely}, (l, r) -> if(l.start <> r.start, l.start - r.start, r.end - l.end))"
        apart = "aggregate(likely, named_struct('at', 0, 'out', slice(likely, 1, 0)), (s, x) -> if(x.start < s.at, s, named_struct('at', x.end, 'out', concat(s.out, array(x)))), s -> s.out)"
        rows = rows.withColumn("likely", F.expr(ordered))
        added = F.expr(apart)
    else:
        added = F.slice("c", 1, 0)
    rows = rows.withColumn("added", added)
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id", *[number(k) for k in BASE], F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op2_pii_weak_supervision(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))

"""Weighted keyword rules that look at context, and what is decided from them.

One projection per table: the catalogue's patterns are literals, so each is
compiled once per task, and nothing is joined or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms that are specific to a category, terms that need a context, and two patterns with a gap.
SPECIFIC = {
    "노동·기업": ["산업안전", "고용지원금", "공정거래", "경영전략"],
    "교통·국토": ["교통신호", "도로보수", "건설현장", "건설현장품질", "건설현장안전", "도시계획", "개발행위", "건설업등록"],
    "주택·건축": ["건축허가", "건축방화", "건축피난", "건축구조", "공동주택", "층간소음", "임대보증금", "전세보증금"],
    "환경·위생": ["미세먼지", "상하수도", "대기오염", "대기질", "공사장소음", "공장소음"],
    "문화·행정·안전": ["민원행정", "생활서비스", "공공서비스", "소화전", "민방위", "지역화폐"],
    "보건·복지": ["복지급여", "여성가족", "감염병"],
}
CONTEXT = {
    ("환경·위생", "대기"): (r"오염|미세먼지|매연|분진|배출가스|유해가스|대기\s*질|환경", r"대기\s*(?:시간|순번|번호|인원|상태|중|줄|표)"),
    ("교통·국토", "인도"): (r"보행|보도|차도|도로|횡단|점자|휠체어|통행|걷|걸어|다니|파손|포장|구멍|적치|침범", r"인도(?:네시아|양|받|하|해|했|할)|(?:상품|물품|제품|목적물).{0,8}인도|인도.{0,8}(?:기한|납기|인수|배송)"),
    ("교통·국토", "공사"): (r"공사\s*(?:장|현장)|착공|시공|준공|굴착|토목|도로|보수|건설|현장", r"한국\s*(?:토지주택|철도|관광)\s*공사"),
}
GAPPED = {("환경·위생", "공사장소음"): r"공사장[^.!?。\n]{0,18}소음", ("환경·위생", "공장소음"): r"공장[^.!?。\n]{0,18}소음"}
OTHER, WINDOW, STRONG, CLEAR, WEIGHT = "기타", 24, 3, 2, 3


def pattern(category: str, keyword: str, gapped: Mapping = GAPPED) -> str:
    """The keyword with blanks allowed between its characters, in any case."""
    return "(?iU)" + gapped.get((category, keyword), r"\s*".join(map(re.escape, keyword)))


def first_place(text: Column, expression: str) -> Column:
    """Start and end of the first match, or null."""
    at = F.regexp_instr(text, F.lit(expression))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(F.regexp_substr(text, F.lit(expression)))).alias("end")))


def place_in_context(text: Column, expression: str, allow: str, deny: str) -> Column:
    """Start and end of the first match whose surroundings match ``allow`` and not ``deny``, or null.

    A match's place is the length of all pieces and matches before it.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(expression), F.lit(0)), F.transform(F.split(text, expression, -1), F.length)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    before = lambda i: total(F.slice(pieces, F.lit(1), i + 1)) + total(F.transform(F.slice(found, F.lit(1), i), F.length))
    starts = F.transform(found, lambda m, i: F.struct(before(i).alias("start"), F.length(m).alias("n")))
    around = F.transform(starts, lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end"), F.substring(text, F.greatest(s["start"] - WINDOW, F.lit(0)) + 1, s["n"] + WINDOW + F.least(s["start"], F.lit(WINDOW))).alias("seen")))
    fit = F.get(F.filter(around, lambda s: s["seen"].rlike(f"(?i){allow}") & ~s["seen"].rlike(f"(?i){deny}")), 0)
    return F.when(text.rlike(expression), fit)


def hits(rows: DataFrame, text: str, catalogue: Mapping[str, Sequence[str]], specific: Mapping = SPECIFIC, gapped: Mapping = GAPPED, context: Mapping = CONTEXT) -> DataFrame:
    """``rows`` with ``hits``: accepted hits, without those that a wider and heavier hit contains.

    The hits become a column before they are compared with each other, so no
    pattern is matched twice.
    """
    places, every, found = {}, [], rows
    for category, words in catalogue.items():
        for keyword in dict.fromkeys(re.sub(r"\s+", "", w) for w in words):
            if keyword:
                p, name, t = pattern(category, keyword, gapped), f"__p{len(places)}", F.col(text)
                places[name] = place_in_context(t, p, *context[(category, keyword)]) if (category, keyword) in context else first_place(t, p)
                weight = WEIGHT if keyword in specific.get(category, ()) else 1
                every.append(F.when(F.col(name).isNotNull(), F.struct(F.lit(category).alias("category"), F.lit(keyword).alias("keyword"), F.lit(weight).alias("weight"), F.col(name)["start"].alias("start"), F.col(name)["end"].alias("end"))))
    heavier = lambda h, o: (o["weight"] > h["weight"]) | ((o["category"] == h["category"]) & (o["weight"] >= h["weight"]))
    wider = lambda h, o: (o["start"] <= h["start"]) & (o["end"] >= h["end"]) & ((o["start"] < h["start"]) | (o["end"] > h["end"]))
    found = found.withColumns(places).withColumn("__found", F.array_compact(F.array(*every))).drop(*places)
    return found.withColumn("hits", F.filter("__found", lambda h: ~F.exists("__found", lambda o: wider(h, o) & heavier(h, o)))).drop("__found")


def classified(rows: DataFrame, text: str, catalogue: Mapping[str, Sequence[str]], specific: Mapping = SPECIFIC, gapped: Mapping = GAPPED, context: Mapping = CONTEXT, other: str = OTHER, deposit: tuple[str, str] | None = ("보증금", r"(?U)(?:임대|전세)\s*보증금")) -> DataFrame:
    """``rows`` with ``hits`` and ``rule``: category, top, margin, reasons, whether a model is needed, and confidence."""

    def score(category: str) -> Column:
        return F.aggregate(F.filter("hits", lambda h: h["category"] == category), F.lit(0), lambda a, h: a + h["weight"])

    scores = F.array(*[F.struct(score(c).alias("score"), F.lit(-i).alias("place"), F.lit(c).alias("name")) for i, c in enumerate(catalogue)])
    ranked = hits(rows, text, catalogue, specific, gapped, context).withColumn("__r", F.sort_array(scores, asc=False))
    best, second = F.col("__r")[0]["score"], F.coalesce(F.get("__r", 1)["score"], F.lit(0))
    margin = best - second
    vague = F.col(text).rlike(deposit[0]) & ~F.col(text).rlike(deposit[1]) if deposit else F.lit(False)
    reasons = F.array_compact(F.array(
        F.when(best == 0, "no_keyword").when(best < STRONG, "weak_score"), F.when((best > 0) & (margin < CLEAR), F.when(margin == 0, "tie").otherwise("small_margin")), F.when(vague, "ambiguous_deposit"),
    ))
    told = ranked.withColumn("__reasons", reasons).withColumn("__needs", F.size(F.array_remove("__reasons", "no_keyword")) > 0)
    confidence = F.when(best == 0, 0.3).when(F.col("__needs"), 0.4).otherwise(0.85)
    category = F.when(best > 0, F.col("__r")[0]["name"]).otherwise(other)
    rule = F.struct(category.alias("category"), best.alias("top"), margin.alias("margin"), F.col("__reasons").alias("reasons"), F.col("__needs").alias("needs_model"), confidence.alias("confidence"))
    return told.withColumn("rule", rule).drop("__r", "__reasons", "__needs")


def wants_model(rule: Column, redacted: Column, enabled: bool = True, other: str = OTHER) -> Column:
    """Whether an imported row deserves a model call."""
    blank = F.length(F.trim(redacted)) == 0
    return F.when(F.lit(not enabled) | blank, False).when(rule["needs_model"], True).when(F.length(redacted) < 20, False).when((rule["category"] == other) & (F.length(redacted) >= 80), False).otherwise(rule["confidence"] < 0.5)


def keyword_score(text: Column, catalogue: Mapping[str, Sequence[str]], other: str = OTHER) -> Column:
    """Category with most keywords in the text, the first on ties, and a confidence band."""
    low = F.lower(text)
    scores = F.array(*[F.struct(sum([F.contains(low, F.lit(w)).cast("int") for w in words], F.lit(0)).alias("score"), F.lit(-i).alias("place"), F.lit(c).alias("name")) for i, (c, words) in enumerate(catalogue.items())])
    best = F.array_max(scores)
    return F.struct(F.when(best["score"] > 0, best["name"]).otherwise(other).alias("category"), best["score"].alias("score"), F.when(best["score"] >= 3, 0.8).when(best["score"] > 0, 0.6).otherwise(0.3).alias("confidence"))


def merged(rule: Column, model: Column, outcome: Column) -> Column:
    """The model's decision when it is usable, else the rule's; the evidence says which."""
    used = (outcome == "ok") & model["category"].isNotNull()
    return F.struct(F.when(used, model["category"]).otherwise(rule["category"]).alias("category"), F.when(used, model["confidence"]).otherwise(rule["confidence"]).alias("confidence"), F.when(used, "model").when(outcome == "failed", "rule after failure").otherwise("rule").alias("evidence"))


def validated(output: Column, categories: Sequence[str], fallback: Column) -> Column:
    """A model's JSON checked field by field over the rule's values."""
    got = F.from_json(output, "category string, summary string, urgency string", {"mode": "PERMISSIVE"})
    ok = got["category"].isin(list(categories)) & (F.length(F.trim(got["summary"])) > 0)
    return F.struct(F.when(ok, got["category"]).otherwise(fallback).alias("category"), F.when(ok, F.left(got["summary"], F.lit(900))).alias("summary"), F.when(got["urgency"].isin("low", "medium", "high"), got["urgency"]).otherwise("medium").alias("urgency"), F.coalesce(ok, F.lit(False)).alias("by_model"))

"""The register of a Korean line by its sentence ending, the register of an entity, and the most frequent endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the registers.
FORMAL, POLITE, NOMINAL, CASUAL, NEUTRAL = "합쇼체", "해요체", "음슴체", "반말", "명사형/기타"

#: Nouns that end in a syllable closed by ㅁ.
NOUNS = """
모음 마음 처음 다음 소음 싸움 도움 배움 어려움 웃음 울음 걸음 믿음 얼음 죽음 젊음 묶음 볶음 졸음 물음 잡음 녹음 발음
복음 굉음 방음 폭음 그림 느낌 기쁨 슬픔 아픔 외침 떨림 울림 흐름 소름 다짐 만남 어둠 오줌 아침 기침 점심
사람 이름 요즘 지금 조금 소금 가슴 여름 구름 기름 보름 바람 알람 새봄 올봄 늦봄
아이템 시스템 프로그램 크림 드림 볼륨 앨범 게임 모임 움직임 타임 라임
고함 포함 결함 전함 군함 잠수함 책임 담임 신임 후임 전임 선임 주임 취임 사임 부임 해임 방임
체험 시험 실험 경험 모험 보험 위험 관심 진심 욕심 결심 중심 조심 양심 의심 호기심 작품 제품 상품 명품 농담 상담
장점 단점 약점 강점 요점 시점 지점 관점 초점 만점 정점 허점 결점 문제점 공통점 차이점
공감 호감 반감 쾌감 영감 예감 실감 직감 식감 촉감 질감 색감 동감 유감 긴장감 존재감 자신감 책임감 만족감 안도감
배신감 위기감 불안감 기대감 거리감 속도감 무게감 현장감 소속감 박탈감 죄책감 열등감 우월감 해방감 친근감 이질감
입체감 몰입감 성취감 절망감 좌절감 허탈감 상실감 압박감 부담감
""".split()

#: Nouns that end in 의 without being genitives.
GENITIVE_LIKE = "거의 회의 주의 동의 합의 강의 논의 문의 정의 예의 의의 협의 건의 결의 제의 호의 편의 성의 고의 모의".split()

#: What may stand after a line's last word, and endings of the registers.
TAIL = "[\\s\"'“”‘’「」『』.,!?~…·ㅋㅎ\\x{1F300}-\\x{1FAFF}]+$"
ENDINGS = [
    (FORMAL, "(습니다|습니까|ㅂ니다|입니다|합니다|됩니다|니다)$"),
    (POLITE, "(요|죠)$"),
    (CASUAL, "(다|냐|니|야|어|아|지|네|자|래|걸|군|나|까|게|대|더라|거든|잖아)$"),
]
#: Hangul syllables, and places of their closing consonants ㅁ, ㅄ and ㅆ.
FIRST, LAST, CLOSINGS, M, BS, SS = 0xAC00, 0xD7A3, 28, 16, 18, 20


def closing(char: Column) -> Column:
    """The place of a syllable's closing consonant, 0 if it is open; null for what is no syllable."""
    code = F.ascii(char)
    return F.when(code.between(FIRST, LAST), (code - FIRST) % CLOSINGS)


def is_nominal(word: Column, before: Column) -> Column:
    """Whether a word is a predicate made a noun by ㅁ; `before` is the word in front of it, or null."""
    last, inner, size = F.right(word, F.lit(1)), closing(F.substring(F.right(word, F.lit(2)), 1, 1)), F.length(word)
    genitive = F.coalesce((F.length(before) >= 2) & before.endswith("의") & ~before.isin(*GENITIVE_LIKE), F.lit(False))
    return (
        F.when(F.coalesce(closing(last), F.lit(0)) != M, False)
        .when(F.rlike(word, F.lit("(?:" + "|".join(NOUNS) + ")$")), False)
        .when(last.isin("됨", "함"), True)
        .when(last == "임", size >= 2)
        .when((last == "음") & (size >= 2) & inner.isin(SS, BS), True)
        .when(genitive, False)
        .when(last == "음", (size >= 2) & (F.coalesce(inner, F.lit(0)) > 0))
        .when(last == "님", word.endswith("아님"))
        .otherwise(size >= 2)
    )


def ending_class(text: Column) -> Column:
    """Struct (register, word) of a line: its register by its last word, and that word; null for a line without words."""
    # bound to names by transform, so the text is split once
    words = F.split(F.regexp_replace(F.trim(text), TAIL, ""), "\\s+")
    last_two = F.transform(F.array(words), lambda w: F.struct(F.element_at(w, -1).alias("word"), F.when(F.size(w) >= 2, F.element_at(w, F.greatest(F.size(w) - 1, F.lit(1)))).alias("before")))
    return F.get(F.transform(last_two, lambda x: _class_of(x["word"], x["before"])), F.lit(0))


def _class_of(word: Column, before: Column) -> Column:
    """ending_class of a line's last word and the one before it."""
    rules = dict(ENDINGS)
    register = (
        F.when(~F.rlike(word, F.lit("[가-힣]$")), NEUTRAL)
        .when(F.rlike(word, F.lit(rules[FORMAL])), FORMAL)
        .when(F.rlike(word, F.lit(rules[POLITE])), POLITE)
        .when(is_nominal(word, before), NOMINAL)
        .when(closing(F.right(word, F.lit(1))) == M, NEUTRAL)
        .when(F.rlike(word, F.lit(rules[CASUAL])), CASUAL)
        .otherwise(NEUTRAL)
    )
    return F.when(F.length(word) > 0, F.struct(register.alias("register"), word.alias("word")))


def entity_register(lines: DataFrame, entity: str, text: str, pos: str, share: float = 0.6, mixed: str = "혼합") -> DataFrame:
    """(entity, register): the register of most lines, neutral ones aside, if its share is at least `share`, else mixed; of equal ones the first seen. Entities with neutral lines only have no row."""
    named = lines.select(entity, pos, ending_class(F.col(text)).alias("e")).where(F.col("e.register") != NEUTRAL)
    counted = named.groupBy(entity, F.col("e.register").alias("register")).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    top = counted.groupBy(entity).agg(F.max_by("register", F.struct("n", -F.col("first"))).alias("register"), (F.max("n") / F.sum("n")).alias("part"))
    return top.select(entity, F.when(F.col("part") >= share, F.col("register")).otherwise(mixed).alias("register"))


def top_endings(lines: DataFrame, text: str, pos: str, k: int = 8) -> DataFrame:
    """(ending, n, rank): the last two characters of the last words of lines that are not neutral, the k most frequent; of equal ones the first seen."""
    named = lines.select(pos, ending_class(F.col(text)).alias("e")).where(F.col("e.register") != NEUTRAL)
    counted = named.groupBy(F.right(F.col("e.word"), F.lit(2)).alias("ending")).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    few = counted.orderBy(F.desc("n"), "first").limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).select("ending", "n", "rank")

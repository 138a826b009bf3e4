"""Accounts, addresses, tags and credit lines that the description of a work names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .observations import stripped

#: How addresses, accounts, communities, tags and credits are written, words for platforms, and tags that say nothing.
ADDRESS = r"(?i)https?://[^\s)>\]\"'<>，、]+"
ACCOUNT = r"(?U)(?<![\w@.])@([A-Za-z0-9_](?:[A-Za-z0-9_.]{0,28}[A-Za-z0-9_])?)"
COMMUNITY = r"(?U)(?<![\w/])((?:u|r)/[A-Za-z0-9_]{2,24})"
TAG = r"#([0-9A-Za-z_가-힣]{2,30})"
CREDIT = r"(?i)(출처|원본|영상\s*출처|원작|제보|source|credits?|cr\.|via|©|ⓒ|original)"
PLATFORMS = {
    "tiktok": ("tiktok", "틱톡", "douyin", "도우인"),
    "instagram": ("instagram", "인스타", "insta", "ig "),
    "reddit": ("reddit", "레딧"),
    "youtube": ("youtube", "유튜브"),
    "x": ("twitter", "트위터", " x "),
    "facebook": ("facebook", "페이스북"),
}
STOP = ("영상", "출처", "구독", "좋아요", "댓글", "shorts", "short", "the", "and", "for", "you", "this", "that")
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def _parts(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")


def named_account(url: Column) -> Column:
    """A struct (platform, account) of an address; the host where the platform is not known, and null where no account is named."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1)), r"^www\.", ""), r"^m\.", "")
    parts = _parts(url)
    one, two = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    at = F.try_element_at(F.filter(parts, lambda p: p.startswith("@")), F.lit(1))
    ends = lambda *names: F.rlike(host, F.lit("(" + "|".join(n.replace(".", r"\.") for n in names) + ")$"))
    insta = F.when(~one.isin("p", "reel", "reels", "tv", "stories", "explore"), F.concat(F.lit("@"), one)).when(one == "stories", F.concat(F.lit("@"), two))
    reddit = F.when(one == "r", F.concat(F.lit("r/"), two)).when(one.isin("u", "user"), F.concat(F.lit("u/"), two))
    youtube = F.coalesce(at, F.when(one.isin("channel", "c", "user"), F.concat(one, F.lit("/"), two)))
    rules = [
        (ends("tiktok.com"), "tiktok", at), (ends("instagram.com"), "instagram", insta), (ends("reddit.com") | (host == "redd.it"), "reddit", reddit), (ends("youtube.com") | (host == "youtu.be"), "youtube", youtube),
        (host.isin("twitter.com", "x.com"), "x", F.when(~one.isin("i", "search", "hashtag"), F.concat(F.lit("@"), one))), (ends("facebook.com") | (host == "fb.watch"), "facebook", F.when(~one.isin("watch", "reel", "share"), one)),
    ]
    platform, account = F.nullif(host, F.lit("")), F.lit(None).cast("string")
    for holds, name, value in reversed(rules):
        platform, account = F.when(holds, F.lit(name)).otherwise(platform), F.when(holds, value).otherwise(account)
    return F.struct(platform.alias("platform"), account.alias("account"))


def profile_of(url: Column, account: Column) -> Column:
    """The address up to and with the part that is the account, as it was read; null if no part is."""
    parts = _parts(url)
    bare = lambda name: F.regexp_replace(name, "^@+", "")
    at = F.array_position(F.transform(parts, bare), F.element_at(F.split(bare(account), "/"), -1)).cast("int")
    return F.when(at > 0, F.concat(F.regexp_extract(url, "^([a-zA-Z]+://[^/?#]*)", 1), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), at), "/")))


def read_descriptions(rows: DataFrame, id_: str, text: str, own: list[str]) -> DataFrame:
    """(id, line, kind, platform, value, url, credit): what each line of a text names, repeats included; null and empty texts name nothing.

    kind: url (every address, its account in value), account_url (an address that names someone else; url is the profile),
    account_credit and account_handle (an @name on a line with and without a credit), account_reddit, hashtag, credit_line (the whole
    line). Lines are counted from 0. A name that holds one of own (letters and digits, in small ones) is the library's own and is
    left out; so are the tags of STOP. Handles and tags inside addresses don't count.
    """
    norm = lambda name: F.regexp_replace(F.lower(name), "[^0-9a-z가-힣]", "")
    mine = [o for o in own if o]
    is_own = lambda name: F.lit(False) if not mine else F.rlike(norm(name), F.lit("|".join(mine)))
    lines = rows.select(id_, F.posexplode(F.split(F.col(text), LINE_END)).alias("line", "raw")).select(id_, "line", stripped(F.col("raw")).alias("raw")).where("raw <> ''")
    low = F.concat(F.lit(" "), F.lower("raw"), F.lit(" "))
    hint = F.lit("unknown")
    for name, words in reversed(PLATFORMS.items()):
        holds = F.lit(False)
        for w in words:
            holds = holds | F.contains(low, F.lit(w))
        hint = F.when(holds, F.lit(name)).otherwise(hint)
    found = lines.select(
        id_, "line", "raw", F.rlike("raw", F.lit(CREDIT)).alias("credit"), hint.alias("hint"), F.regexp_replace("raw", ADDRESS, " ").alias("rest"),
        F.transform(F.regexp_extract_all("raw", F.lit(ADDRESS), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")).alias("urls"),
    )
    null = F.lit(None).cast("string")

    def entry(kind, platform: Column, value: Column, url: Column = null) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), platform.cast("string").alias("platform"), value.cast("string").alias("value"), url.cast("string").alias("url"))

    named = F.transform("urls", lambda u: F.struct(u.alias("url"), named_account(u).alias("of")))
    others = F.filter(named, lambda n: F.coalesce(n["of"]["account"] != "", F.lit(False)) & ~is_own(F.coalesce(n["of"]["account"], F.lit(""))))
    at = F.filter(F.transform(F.regexp_extract_all("rest", F.lit(ACCOUNT), F.lit(1)), lambda h: F.concat(F.lit("@"), h)), lambda h: ~is_own(h))
    tags = F.filter(F.regexp_extract_all("rest", F.lit(TAG), F.lit(1)), lambda t: ~F.lower(t).isin(*STOP) & ~is_own(t))
    kinds = [
        F.transform(named, lambda n: entry("url", n["of"]["platform"], n["of"]["account"], n["url"])),
        F.transform(others, lambda n: entry("account_url", n["of"]["platform"], n["of"]["account"], profile_of(n["url"], n["of"]["account"]))),
        F.transform(at, lambda h: entry(F.when(F.col("credit"), "account_credit").otherwise("account_handle"), F.col("hint"), h)),
        F.transform(F.regexp_extract_all("rest", F.lit(COMMUNITY), F.lit(1)), lambda r: entry("account_reddit", F.lit("reddit"), r)),
        F.transform(tags, lambda t: entry("hashtag", null, t)),
        F.when(F.col("credit"), F.array(entry("credit_line", null, F.col("raw")))).otherwise(F.array().cast("array<struct<kind:string,platform:string,value:string,url:string>>")),
    ]
    return found.select(id_, F.col("line").cast("long").alias("line"), "credit", F.explode(F.concat(*kinds)).alias("x")).select(id_, "line", "x.kind", "x.platform", "x.value", "x.url", "credit")

"""Keywords of product names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that Chinese keywords leave out.
CN_STOP = (
    "的了在是我有和就不人都一个上也很到说要去你会着没看好自这他她它那们与及或为以而从被把让向对于由其可能所但只各如此之后前中"
    "大小多少新旧高低长短快慢款型号色码尺寸品牌货价格包邮现批零售正保证原单装韩版欧美日风潮流百搭休闲春夏秋冬季男女通儿童老少轻奢简约复古刺绣印花纯棉"
)

# General English words that keywords and consensus words leave out.
EN_GENERAL = (
    "inch with and for the new hot best high quality premium sale free size color large small medium style model brand made "
    "china product goods item type set pack piece unit each per cm mm meter gram kg"
).split()

# Further words that keywords leave out, the colours last named among them.
EN_SPECIAL = (
    "dual sim ram rom version global middle east black white blue grey gold silver red green pink brown yellow purple orange "
    "portable smart magnetic liquid silicone matte flash magic tempered glass screen protector"
).split()
EN_STOP = [*EN_GENERAL, *EN_SPECIAL]

# Brands that keywords leave out.
EN_BRANDS = (
    "xiaomi redmi samsung apple macbook galaxy black shark huawei honor oneplus oppo vivo realme nokia motorola google pixel "
    "lenovo dell asus acer sony lg philips panasonic bosch siemens"
).split()

#: The name anchor keeps these colours, which keywords leave out.
ANCHOR_STOP = [w for w in EN_STOP if w not in "red green pink brown yellow purple orange".split()]

#: The consensus word leaves out the general words only.
CONSENSUS_STOP = EN_GENERAL

#: Characters between words: the white space of Unicode, information separators included, and marks.
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
PLAIN_SPLIT = _SPACE + "-/,.;:()[]{}"
_PIPE_SPLIT = PLAIN_SPLIT + "|"
#: Digits that are no decimal numbers: superscripts, subscripts, circled ones and the like.
_ODD_DIGITS = "".join(c for c in map(chr, range(0x20000)) if c.isdigit() and not c.isdecimal())
_NUMBER = rf"^[\p{{Nd}}{_ODD_DIGITS}]+$"


def tokens(text: str | Column, longer_than: int, stop: list[str] = (), split: str = _PIPE_SPLIT) -> Column:
    """Distinct lower-case tokens of more than ``longer_than`` characters that are no stop words and no numbers; null gives none.

    ``split`` has the characters between tokens. Tokens become distinct and stop words go before any other test, so that each
    token is tested once. ``longer_than`` is 0 or more.
    """
    text = F.col(text) if isinstance(text, str) else text
    left_out = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    # One separator instead of a pattern: empty tokens between two of them are too short to stay.
    parts = F.array_except(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), split, " " * len(split)), " "), left_out)
    # A token that begins with one of a to z is no number; only the others are held against the pattern.
    worded = lambda t: (t >= "a") & (t < "{")
    return F.filter(parts, lambda t: (F.length(t) > longer_than) & (worded(t) | ~t.rlike(_NUMBER)))


def keywords_en(text: str | Column, min_len: int = 3) -> Column:
    """English keywords, sorted and joined by spaces."""
    return F.array_join(F.sort_array(tokens(text, min_len, [*EN_STOP, *EN_BRANDS])), " ")


def keywords_cn(text: str | Column) -> Column:
    """All one- to three-grams of a text's Chinese characters without the stop characters, sorted and joined by spaces."""
    text = F.col(text) if isinstance(text, str) else text
    chars = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[一-鿿&&[^{CN_STOP}]]"), F.lit(0))

    def grams(held: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.size(held) - n + 1)
        made = F.transform(at, lambda i: F.array_join(F.slice(held, i, n), ""))
        return F.when(F.size(held) >= n, made).otherwise(F.array().cast("array<string>"))

    # The characters are bound first, so that they are found once and not for each place.
    every = F.flatten(F.transform(F.array(chars), lambda c: F.concat(grams(c, 1), grams(c, 2), grams(c, 3))))
    return F.array_join(F.array_sort(F.array_distinct(every)), " ")


def anchor_tokens(name: str | Column) -> Column:
    """Tokens that a top hit's name shares with other hits: words of two or more characters, and each Chinese character in them."""
    words = tokens(name, 1, [*ANCHOR_STOP, *EN_BRANDS])
    single = F.flatten(F.transform(words, lambda t: F.regexp_extract_all(t, F.lit("[一-鿿]"), F.lit(0))))
    return F.array_distinct(F.concat(words, single))


def ocr_tokens(text: str | Column) -> Column:
    """Tokens of recognised text: more than two characters."""
    return tokens(text, 2, split=PLAIN_SPLIT)

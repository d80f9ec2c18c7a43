"""Normalisers and identifiers of bibliographic text, as column expressions.

Patterns that start with (?U) treat blanks and digits as Unicode does. Missing values are empty strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges and word lists that results depend on.
HANGUL, HAN, KANA = "가-힣", "一-鿿", "぀-ゟ゠-ヿ"
YEAR = r"(?:18|19|20)\d{2}"
DOI_LINK = r"(?iU)(?:https?://(?:dx\.)?doi\.org/|doi[:\s]\s*)(10\.\d{4,9}/[^\s,;”\"]+)"
URL = r"(?U)https?://[^\s。)\]”\"]+"
#: All that Unicode calls white space, as (?U)\s does.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: ASCII characters that no key has.
ASCII_MARKS = "".join(chr(k) for k in range(128) if not chr(k).isalnum())
LEGAL_FORMS = r"(?iU)\(\s*[주유재사합]\s*\)|㈜|주식회사|유한회사|재단법인|사단법인|도서출판|\b(?:inc|ltd|co|corp|company)\b\.?"


def sub(c: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(c, pattern, new)


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column, chars: str) -> Column:
    """Without any of these characters at the end."""
    return F.rtrim(c, F.lit(chars))


def lstrip(c: Column, chars: str) -> Column:
    return F.ltrim(c, F.lit(chars))


def either(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.when(c != "", c) for c in columns), F.lit(""))


def group(c: Column, pattern: str, number: int = 0) -> Column:
    """A group of the first match, the empty string if there is none."""
    return F.coalesce(F.regexp_extract(c, pattern, number), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of blanks become one, none at the ends."""
    return strip(sub(c, r"(?U)\s+", " "))


def squeeze(c: Column) -> Column:
    """Runs of two or more blanks become one space."""
    return sub(c, r"(?U)\s{2,}", " ")


def script_class(c: Column) -> Column:
    """ko, east or west by the first 60 characters: Hangul, else Han or kana, else Latin, else ko."""
    head = F.substring(c, 1, 60)
    return F.when(head.rlike(f"[{HANGUL}]"), "ko").when(head.rlike(f"[{HAN}{KANA}]"), "east").when(head.rlike("[A-Za-z]"), "west").otherwise("ko")


def folded(c: Column) -> Column:
    """Text in lower case, with the four characters that patterns without case take for the ASCII letters s, k and i as these."""
    return F.lower(F.translate(c, "ſKıİ", "skii"))


def compare_key(c: Column) -> Column:
    """Text without blanks, punctuation and quotes; hyphens stay, so that page ranges differ from numbers."""
    return F.translate(F.coalesce(c, F.lit("")), f"{BLANKS}.,;:：()[]“”\"'·", "")


def publisher_key(c: Column) -> Column:
    """A publisher's name without its legal form, hyphens and punctuation, in lower case."""
    return compare_key(sub(sub(F.lower(F.coalesce(c, F.lit(""))), LEGAL_FORMS, ""), "[-–—]+", ""))


def title_key(c: Column) -> Column:
    """Words of a title in lower case: digits and letters of the common scripts, single spaces between."""
    kept = f"0-9A-Za-z{HANGUL}{HAN}{KANA}・ー０-９Ａ-Ｚａ-ｚЀ-ӿΑ-Ωα-ω"
    return strip(sub(F.lower(F.coalesce(c, F.lit(""))), f"[^{kept}]+", " "))


def _bare_key(c: Column, kept: str) -> Column:
    """Digits, Latin letters and the characters of a class only, in lower case. ASCII goes without a pattern; only strings with other characters need one."""
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), ASCII_MARKS, "")
    return F.when(low.rlike(r"^[0-9a-z]*\z"), low).otherwise(sub(low, f"[^0-9a-z{kept}]", ""))


def solid_key(c: Column) -> Column:
    """Digits, Latin letters, Hangul and Han only, in lower case."""
    return _bare_key(c, HANGUL + HAN)


def hangul_key(c: Column) -> Column:
    """Digits, Latin letters and Hangul only, in lower case."""
    return _bare_key(c, HANGUL)


def without_authors(c: Column) -> Column:
    """What follows the leading authors and year in parentheses; the whole if nothing does."""
    s = F.coalesce(c, F.lit(""))
    return either(strip(sub(s, r"^.*?\((?:\d{4}[a-z]?|n\.d\.|발행년불명)[^)]*\)\.\s*", "")), strip(s))


def bare_doi(c: Column) -> Column:
    """A DOI without its resolver's address."""
    return sub(strip(F.coalesce(c, F.lit(""))), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", "")


def doi_of(c: Column) -> Column:
    """DOI after a resolver's address or the word doi."""
    return rstrip(group(c, DOI_LINK, 1), ".")


def any_doi(c: Column) -> Column:
    """DOI anywhere, without punctuation at its end."""
    return rstrip(group(c, r"(?U)\b10\.\d{4,9}/[^\s\"'<>]+"), ".,;)]}。")


def url_of(c: Column) -> Column:
    return rstrip(group(c, URL), ".,)")


def isbn_digits(c: Column) -> Column:
    """ISBN characters only: blanks, hyphens and a leading label dropped."""
    return sub(sub(F.coalesce(c, F.lit("")), r"(?U)[\s\-]", ""), "(?i)^ISBN:*", "")


def main_title(c: Column) -> Column:
    """The main title of a catalogue record: before a parallel title, without bracketed parts, before a colon, without punctuation at the ends."""
    head = F.split_part(collapse(F.coalesce(c, F.lit(""))), F.lit(" = "), F.lit(1))
    head = sub(sub(head, r"[(（\[].*?[)）\]]", " "), r"(?U)\s*[:：].*$", "")
    return F.trim(rstrip(lstrip(collapse(head), " .,:;-–—"), " .,:;-–—"))


def without_tags(c: Column) -> Column:
    return collapse(sub(F.coalesce(c, F.lit("")), "<[^>]+>", ""))


def safe_name(c: Column) -> Column:
    """A file name without folders, reserved and control characters, 120 characters at most."""
    return F.substring(sub(sub(c, r"^.*[/\\]", ""), r"[\x00-\x1f<>:\"/\\|?*]", "_"), 1, 120)


def plain_year(c: Column) -> Column:
    """Year without the letter that tells works of one year apart."""
    return sub(F.coalesce(c, F.lit("")), "[a-z]$", "")


def year_number(c: Column) -> Column:
    """The first four characters as a number if they are digits, else null."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4})", 1).try_cast("int")


def first_page(c: Column) -> Column:
    return group(strip(F.coalesce(c, F.lit(""))), r"^\d+")


def input_kind(c: Column) -> Column:
    """Struct kind, value of a one-line query: doi, isbn, url or title, in this order."""
    q = strip(F.coalesce(c, F.lit("")))
    doi, isbn = any_doi(q), isbn_digits(q)

    def as_kind(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    named = F.when(doi != "", as_kind("doi", doi)).when(isbn.rlike(r"^(97[89]\d{10}|\d{9}[\dXx])$"), as_kind("isbn", isbn))
    return named.when(q.rlike("(?i)^https?://"), as_kind("url", q)).otherwise(as_kind("title", q))


def blocked_address(c: Column) -> Column:
    """True for links that must not be fetched: other schemes, no host, local names, private, loopback, link-local and reserved IPv4 or IPv6 addresses.

    Names are judged as written; resolving them is left to whoever fetches.
    """
    host = F.lower(F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("")), r"[\[\]]", ""))
    parts = F.split(host, r"\.")
    n = [F.get(parts, F.lit(k)).try_cast("int") for k in range(4)]
    is_v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    reserved = n[0].isin(0, 10, 127) | (n[0] >= 224) | ((n[0] == 172) & n[1].between(16, 31)) | ((n[0] == 192) & (n[1] == 168)) | ((n[0] == 169) & (n[1] == 254)) | ((n[0] == 100) & n[1].between(64, 127)) | ((n[0] == 192) & (n[1] == 0)) | ((n[0] == 198) & n[1].isin(18, 19))
    local = host.isin("", "localhost") | host.endswith(".localhost") | host.endswith(".local") | host.rlike("^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)")
    return ~F.coalesce(F.lower(c).rlike("^https?://"), F.lit(False)) | local | F.coalesce(is_v4 & reserved, F.lit(False))

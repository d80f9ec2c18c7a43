"""Letter case and author names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.text import lstrip, rstrip, strip, sub

# Words that stay small in titles, and words that mark a body's name.
SMALL_WORDS = ["a", "an", "the", "and", "or", "of", "in", "on", "for", "to", "with", "at", "by", "from", "as", "but", "nor", "vs"]
BODY_LINK_WORDS = ["of", "on", "the", "for", "and", "in", "at", "&"]
BODY_WORDS = (
    "association society institute institution university college school library libraries group committee council department division ministry agency bureau center "
    "centre foundation organization organisation board commission office museum archives federation union corporation company press national international federal "
    "administration network consortium academy authority service services project"
).split()


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def _upper(w: Column) -> Column:
    """An abbreviation: two or more characters, of which some are letters and none is a small one."""
    return (F.length(w) >= 2) & (F.upper(w) == w) & (F.lower(w) != w)


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))


def title_case(c: Column) -> Column:
    """Every word with a capital but small words inside; abbreviations stay, a word after a colon starts anew."""
    small = F.array(*[F.lit(w) for w in SMALL_WORDS])
    words = words_of(c)
    # each word with the one before it, so that no lambda needs the whole array
    pairs = F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit(":")), words).alias("b"))

    def one(p: Column) -> Column:
        w, before = p["w"], p["b"]
        opens = before.rlike("[:：]$")
        return F.when(_upper(w), w).when(~opens & F.array_contains(small, F.lower(w)), F.lower(w)).otherwise(_capital(w))

    cased = F.array_join(F.transform(F.filter(pairs, lambda p: p["w"].isNotNull()), one), " ")
    return F.when(c.rlike("[A-Za-z]"), cased).otherwise(c)


def sentence_case(c: Column) -> Column:
    """One capital at the start and one after the first colon, if half of the words (two at least, of over three) have one; else only the start."""
    words = words_of(c)
    later = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    capitals = F.size(F.filter(later, lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}") & ~_upper(w)))
    lowered = F.array_join(F.transform(words, lambda w, i: F.when(_upper(w), w).when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))).otherwise(F.lower(w))), " ")
    at = F.regexp_instr(lowered, F.lit(r"(?U):\s*[a-z]"))
    gap = F.length(F.regexp_extract(lowered, r"(?U):\s*(?=[a-z])", 0))
    letter = at + gap
    raised = F.when(at > 0, F.concat(F.substring(lowered, F.lit(1), letter - 1), F.upper(F.substring(lowered, letter, F.lit(1))), F.substring(lowered, letter + 1, F.length(lowered)))).otherwise(lowered)
    titled = (F.size(words) > 3) & (capitals >= F.greatest(F.lit(2), F.floor(F.size(words) * 0.5)))
    return F.when(~c.rlike("[A-Za-z]"), c).when(titled, raised).otherwise(_capital(c))


def is_body(name: Column) -> Column:
    """A corporate name: two or more words with a linking word or a word such as association among them."""
    return F.lower(name).rlike(rf"(?U)(?:^|[\s,])\.*(?:{'|'.join([*BODY_LINK_WORDS, *BODY_WORDS])})\.*(?:[\s,]|\z)") & name.rlike(r"(?U)[^\s,][\s,]+[^\s,]")


def western_name(name: Column) -> Column:
    """Surname and initials; corporate names and single words stay as they are."""
    bare = rstrip(strip(name), ".")
    parts = F.split(bare, r"(?U)\s+")
    comma = F.instr(bare, ",") > 0
    last = F.when(comma, strip(F.split_part(bare, F.lit(","), F.lit(1)))).otherwise(F.element_at(parts, -1))
    first = F.when(comma, strip(sub(bare, "^[^,]*,", ""))).otherwise(sub(bare, r"(?U)\s*\S+$", ""))
    initials = F.array_join(F.transform(F.filter(F.split(first, r"(?U)[\s.\-]+"), lambda w: w.rlike(r"^\p{L}")), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")
    # without initials the comma goes again: a surname has none at its end
    turned = rstrip(F.concat(last, F.lit(", "), initials), ", ")
    return F.when((bare == "") | (~comma & (F.size(parts) == 1)) | is_body(bare), bare).otherwise(turned)


def author_line(authors: Column, note: Column, lang: Column) -> Column:
    """Authors as one string: western ones turned and joined with an ampersand, others joined by commas; the role follows."""
    named = F.filter(F.transform(authors, strip), lambda a: a != "")
    n = F.size(named)

    def turned(west: Column) -> Column:
        size = F.size(west)
        last = F.coalesce(F.try_element_at(west, F.lit(-1)), F.lit(""))
        many = F.concat(F.array_join(F.slice(west, F.lit(1), F.greatest(size - 1, F.lit(0))), ", "), F.lit(", & "), last)
        return F.when(size == 1, F.get(west, F.lit(0))).when(size == 2, F.concat(F.get(west, F.lit(0)), F.lit(" & "), F.get(west, F.lit(1)))).otherwise(many)

    # the names are turned once, whatever uses them
    joined = F.get(F.transform(F.array(F.transform(named, western_name)), turned), F.lit(0))
    role = strip(F.coalesce(note, F.lit("")))
    joined = F.concat(joined, F.when(role == "", "").when(role.endswith("."), F.concat(F.lit(" "), role)).otherwise(F.concat(F.lit(" "), role, F.lit("."))))
    other = F.concat(F.array_join(named, ", "), F.when(role == "", "").otherwise(F.concat(F.lit(" "), role)))
    return F.when(n == 0, "").when(lang == "west", joined).otherwise(other)


def split_authors(c: Column, lang: Column) -> Column:
    """Single names of an author string.

    And, ampersands and middle dots are commas. In western lists a surname and the initials after it are one author, as is a lone surname with one
    given name; et al. goes. Elsewhere each part is one author.
    """
    unified = sub(F.translate(sub(sub(c, r"(?U)\s+and\s+", ","), r"(?U)\s+(와|과)\s+", ","), "&·․‧", ",,,,"), ",+", ",")
    parts = F.filter(F.transform(F.split(unified, ","), strip), lambda p: p != "")
    initials = r"(?U)^(?:[A-Z]\.?\s*)+(?:Jr\.?|Sr\.?)?$"
    # left to right: initials that follow an open surname complete it, anything else opens a new author
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, p: Column) -> Column:
        closed = F.when(a["open"].isNull() | F.lower(a["open"]).isin("et al", "et al."), a["done"]).otherwise(F.array_append(a["done"], a["open"]))
        joins = a["open"].isNotNull() & p.rlike(initials)
        return F.struct(
            F.when(joins, F.array_append(a["done"], F.concat(a["open"], F.lit(", "), rstrip(p, ".")))).otherwise(closed).alias("done"),
            F.when(~joins, p).alias("open"),
        )

    def western(parts: Column) -> Column:
        given = F.get(parts, F.lit(1))
        alone = (F.size(parts) == 2) & given.rlike(r"(?U)^[A-Z][a-z]+(?:\s[A-Z][a-z]+)?$") & ~given.rlike(r"(?U)^(?:[A-Z]\.?\s*)+$")
        paired = F.aggregate(parts, start, step, lambda a: F.when(a["open"].isNull() | F.lower(a["open"]).isin("et al", "et al."), a["done"]).otherwise(F.array_append(a["done"], a["open"])))
        return F.when(alone, F.array(F.concat(F.get(parts, F.lit(0)), F.lit(", "), given))).otherwise(paired)

    # the string is split once, whatever uses the parts
    west = F.get(F.transform(F.array(parts), western), F.lit(0))
    return F.when(lang == "west", west).otherwise(F.filter(parts, lambda p: p != "외"))


def clean_names(authors: Column) -> Column:
    """Names without affiliations: what follows a semicolon or stands in parentheses goes, as do names of over 60 characters."""
    bare = F.transform(authors, lambda a: rstrip(lstrip(sub(sub(F.split_part(a, F.lit(";"), F.lit(1)), r"(?U)\s*[(（][^)）]*[)）]\s*", " "), r"(?U)\s+", " "), " ,."), " ,."))
    return F.filter(bare, lambda a: (a != "") & (F.length(a) <= 60))

"""Column functions for names, keys, codes, display lines and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import let

BLANK = r"(?U)^\s+|\s+$"


def blank_to_null(c: Column) -> Column:
    """Trimmed of all Unicode white space; NULL where nothing is left."""
    return F.nullif(F.regexp_replace(c, BLANK, ""), F.lit(""))


#: Head nouns in which municipal titles end, and titles that stand before a name.
TITLE_ENDS = ("stadt", "gemeinde", "flecken", "bad", "kurort")
TITLES = ("Stadtgemeinde", "Stadt", "Gemeinde")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def before(c: Column, rest: Column) -> Column:
    """c without the mark and the text ``rest`` that follow at its end."""
    return F.substr(c, F.lit(1), F.char_length(c) - F.char_length(rest) - 1)


def lead(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def tail(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def place_name(c: Column) -> Column:
    """A municipality without the second-language name in brackets behind it, the title behind its last comma, and one title before it."""

    def without_brackets(name: Column) -> Column:
        # what stands between the last closing bracket and the one before it, or the name's begin
        def of(inner: Column) -> Column:
            held = F.char_length(inner) - F.instr(inner, "[")  # behind the first opening bracket
            cut = tail(F.substr(name, F.lit(1), F.char_length(name) - held - 2))
            return F.when(name.endswith("]") & F.contains(inner, F.lit("[")), cut).otherwise(name)

        return let(F.substring_index(F.substr(name, F.lit(1), F.char_length(name) - 1), "]", -1), of)

    def without_end(name: Column) -> Column:
        def of(last: Column) -> Column:
            ends = F.exists(F.array(*map(F.lit, TITLE_ENDS)), lambda noun: F.endswith(F.lower(last), noun))
            plain = let(lead(last), lambda words: F.regexp_replace(words, r"[^\p{L}. \-]", "") == words)
            return F.when(F.contains(name, F.lit(",")) & ends & plain, before(name, last)).otherwise(name)

        return let(F.substring_index(name, ",", -1), of)

    def without_title(name: Column) -> Column:
        return let(F.substring_index(F.regexp_replace(name, r"(?U)\s", " "), " ", 1), lambda first: F.when(first.isin(*TITLES) & (first != name), lead(F.substr(name, F.char_length(first) + 1))).otherwise(name))

    return F.nullif(let(let(let(trimmed(c), without_brackets), without_end), without_title), F.lit(""))


def street_name(c: Column) -> Column:
    return blank_to_null(c)


def postcode(c: Column) -> Column:
    """Five ASCII digits, or NULL."""
    c = F.regexp_replace(c, BLANK, "")
    return F.when(c.rlike("^[0-9]{5}$"), c)


def named_district(c: Column) -> Column:
    """NULL for numbered districts, which say no more than the municipality."""
    words = F.split(c, " ")
    at = lambda k: F.try_element_at(words, F.lit(k))
    numbered = (F.size(words) > 2) & (at(-2) == "Bezirk") & (at(-1) != "") & (F.translate(at(-1), "0123456789", "") == "")
    return F.when(~F.coalesce(numbered, F.lit(False)), c)


def key_part(c: Column, spaces: bool) -> Column:
    """Lower case, sharp s as ss, hyphens and white space as one space or none."""
    c = F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss")), r"(?U)[\s\-]+", " " if spaces else "")
    return F.trim(c)


def street_key(c: Column) -> Column:
    return F.regexp_replace(key_part(c, True), r"str\.(?=\s|$)", "strasse")


def address_key(gemeinde: Column, street: Column, number: Column, suffix: Column) -> Column:
    return F.concat_ws("\x1f", key_part(gemeinde, True), street_key(street), key_part(number, False), key_part(suffix, False))


#: What stands before the digits of a CRS name.
AUTHORITIES = ("EPSG::", "EPSG:", "EPSG/0/", "EPSG/")
DIGITS = "0123456789"


def epsg(c: Column) -> Column:
    """Code of a CRS name in its urn, URL, short or state-survey form; NULL where it is none."""

    def of(name: Column) -> Column:
        ahead = F.rtrim(name, F.lit(DIGITS))
        digits = F.nullif(F.substr(name, F.char_length(ahead) + 1), F.lit(""))
        told = F.exists(F.array(*map(F.lit, AUTHORITIES)), lambda a: F.endswith(ahead, a))
        code = F.when(told, F.try_to_number(digits, F.lit("9999999999")).try_cast("int"))
        # the first survey name of zone 31 to 33 that no digit follows
        zones = F.filter(F.slice(F.split(name, "ETRS89_UTM"), 2, 1_000_000), lambda p: F.left(p, F.lit(2)).isin("31", "32", "33") & ~F.contains(F.lit(DIGITS), F.nullif(F.substr(p, F.lit(3), F.lit(1)), F.lit(""))).eqNullSafe(True))
        return F.coalesce(code, F.left(F.get(zones, F.lit(0)), F.lit(2)).cast("int") + 25800)

    return let(F.upper(trimmed(c)), of)


def joined(sep: str, *parts: Column) -> Column:
    """The parts that aren't blank, with a separator."""
    return F.concat_ws(sep, *(F.when(F.trim(p) != "", p) for p in parts))


def street_line(street: Column, number: Column, suffix: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.trim(F.concat(some(street), F.lit(" "), some(number), some(suffix)))


def place_line(plz: Column, ort: Column, gemeinde: Column) -> Column:
    place = F.trim(F.concat(F.coalesce(plz, F.lit("")), F.lit(" "), F.coalesce(ort, F.lit(""))))
    same = gemeinde.isNull() | (F.trim(gemeinde) == "") | F.equal_null(gemeinde, ort)
    return F.when(same, place).otherwise(F.concat(place, F.lit(" · "), gemeinde))


def known(part: Column) -> Column:
    """A number or suffix unless the source says it isn't unique."""
    return F.when(F.lower(F.trim(part)) != "uneindeutig", part)


def url_part(c: Column) -> Column:
    """Percent-encoded as RFC 3986 has it."""
    c = F.url_encode(c)
    for form, uri in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        c = F.replace(c, F.lit(form), F.lit(uri))
    return c


#: Addresses of the maps linked to.
SEARCH_MAP = "https://www.google.com/maps/search/"
OPEN_MAP = "https://www.openstreetmap.org/"
NOISE = {"nrw": "https://www.umgebungslaerm-kartierung.nrw.de/", "sh": "https://danord.gdi-sh.de/viewer/resources/apps/umgebungslaerm/index.html?lang=de"}
FLOOD_PLAIN = "https://www.hochwasserkarten.nrw.de/"
FLOOD_APP = "https://www.giscloud.nrw.de/arcgis/apps/experiencebuilder/experience/?id=222e772d0d4543819ddaae90346e2c51"
#: Names of the states by source.
STATES = {
    "bw": "Baden-Württemberg",
    "by": "Bayern",
    "be": "Berlin",
    "bb": "Brandenburg",
    "hb": "Bremen",
    "hh": "Hamburg",
    "he": "Hessen",
    "mv": "Mecklenburg-Vorpommern",
    "ni": "Niedersachsen",
    "nrw": "Nordrhein-Westfalen",
    "rp": "Rheinland-Pfalz",
    "sl": "Saarland",
    "sn": "Sachsen",
    "st": "Sachsen-Anhalt",
    "sh": "Schleswig-Holstein",
    "th": "Thüringen",
}


def links(street: Column, number: Column, suffix: Column, plz: Column, ort: Column, source: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """Search, marker, noise and flood links of a row."""
    query = url_part(joined(", ", street_line(street, known(number), known(suffix)), plz, ort))
    # six decimals; a decimal number prints without exponent and trailing zeros are cut
    say = lambda c: F.regexp_replace(F.format_string("%.6f", F.round(c.cast("double"), 6)), r"\.?0+$", "")
    at = lat.isNotNull() & lon.isNotNull()
    centre = F.concat(F.lit("center:"), say(lon), F.lit("%2C"), say(lat), F.lit("%2C4326,scale:5000"))
    noise = F.lit(None).cast("string")
    for s, url in NOISE.items():
        noise = F.when(source == s, F.lit(url)).otherwise(noise)
    flood = F.when((source == "nrw") & at, F.concat(F.lit(f"{FLOOD_APP}#widget_567="), centre, F.lit("&widget_568="), centre)).when(source == "nrw", F.lit(FLOOD_PLAIN))
    return {
        "search_link": F.concat(F.lit(SEARCH_MAP), query),
        "marker_link": F.when(at, F.concat(F.lit(f"{OPEN_MAP}?mlat="), say(lat), F.lit("&mlon="), say(lon), F.lit("&zoom=17"))).otherwise(F.concat(F.lit(f"{OPEN_MAP}search?query="), query)),
        "noise_link": noise,
        "flood_link": flood,
    }


def state_name(source: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, F.lower(source)), source)


LETTERS = "abcdefghijklmnopqrstuvwxyz"
ADDRESS = "struct<str:string,hnr:string,hnr_zus:string>"


def text_parts(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), ";"), trimmed)


def without_letter(token: Column, use) -> Column:
    """use(what stands before the letter at a token's end and one space before that, the letter or NULL), the token being computed once."""

    def of(token: Column, last: Column) -> Column:
        lettered = (last != "") & (F.translate(F.lower(last), LETTERS, "") == "")
        cut = F.left(token, F.char_length(token) - 1)
        body = F.when(lettered, F.when(cut.endswith(" "), F.left(cut, F.char_length(cut) - 1)).otherwise(cut)).otherwise(token)
        return let(body, lambda b: use(b, F.when(lettered, last)))

    return let(token, lambda t: let(F.right(t, F.lit(1)), lambda last: of(t, last)))


def house(token: Column) -> Column:
    """hnr and hnr_zus of a token that is a house number: digits, then a letter perhaps, with a space before it perhaps. Else NULL."""
    return without_letter(token, lambda body, letter: F.when((body != "") & (F.translate(body, DIGITS, "") == ""), F.struct(body.alias("hnr"), letter.alias("hnr_zus"))))


def street_and_house(piece: Column) -> Column:
    """str, hnr and hnr_zus of a piece that ends in a house number behind white space and a street. Else NULL."""

    def of(body: Column, letter: Column) -> Column:
        def apart(ahead: Column) -> Column:
            digits = F.substr(body, F.char_length(ahead) + 1)
            return let(tail(ahead), lambda street: F.when((digits != "") & (street != "") & (street != ahead), F.struct(street.alias("str"), digits.alias("hnr"), letter.alias("hnr_zus"))))

        return let(F.rtrim(body, F.lit(DIGITS)), apart)

    return without_letter(tail(piece), of)


def read_part(part: Column) -> Column:
    """array of the addresses of one part, NULL if it ends in no list of house numbers behind a street.

    Pieces between commas are read from the right: those that are house numbers, and the one before
    them if it ends in one; the street is what stands before."""

    def of(pieces: Column) -> Column:
        return let(F.transform(pieces, lambda p: house(trimmed(p))), lambda alone: whole(pieces, alone))

    def whole(pieces: Column, alone: Column) -> Column:
        last = F.array_max(F.transform(alone, lambda h, i: F.when(h.isNull(), i + 1).otherwise(0)))  # the last piece that is no house number
        return let(last, lambda k: let(F.when(k > 0, street_and_house(F.get(pieces, k - 1))), lambda end: listed(pieces, alone, k, end)))

    def listed(pieces: Column, alone: Column, k: Column, end: Column) -> Column:
        # without a number in that piece, the first house number behind a comma and white space begins the list
        begins = F.array_min(F.transform(pieces, lambda p, i: F.when((i >= k) & (lead(p) != p), i + 1)))
        joined_ = lambda n: F.array_join(F.slice(pieces, 1, n), ",")
        with_end = F.concat(F.array(F.struct(F.concat(F.when(k > 1, F.concat(joined_(F.greatest(k - 1, F.lit(0))), F.lit(","))).otherwise(F.lit("")), end["str"]).alias("str"), end["hnr"].alias("hnr"), end["hnr_zus"].alias("hnr_zus"))), F.transform(F.slice(alone, k + 1, F.size(alone)), lambda h: F.struct(F.lit(None).cast("string").alias("str"), h["hnr"].alias("hnr"), h["hnr_zus"].alias("hnr_zus"))))
        behind = let(begins, lambda b: F.when(b > 1, F.transform(F.slice(alone, b, F.size(alone)), lambda h: F.struct(F.concat(joined_(b - 1), F.lit(",")).alias("str"), h["hnr"].alias("hnr"), h["hnr_zus"].alias("hnr_zus")))))
        first = F.when(end.isNotNull(), with_end).otherwise(behind)
        # one street for all
        return let(first, lambda all_: F.transform(all_, lambda x: F.struct(F.get(all_, F.lit(0))["str"].alias("str"), x["hnr"].alias("hnr"), x["hnr_zus"].alias("hnr_zus"))))

    return let(F.split(part, ","), of)


def addresses_in(text: Column) -> Column:
    """array<struct<str, hnr, hnr_zus>> of the addresses a parcel text names, each once, in order.

    A part names a street with two letters at least, then its house numbers up to the part's end."""

    def named(read: Column) -> Column:
        letters = F.char_length(F.regexp_replace(F.get(read, F.lit(0))["str"], r"[^\p{L}]", ""))
        return F.when(read.isNotNull() & (letters >= 2), read).otherwise(F.array().cast(f"array<{ADDRESS}>"))

    return F.array_distinct(F.flatten(F.transform(text_parts(text), lambda p: let(read_part(p), named))))


def unread_parts(text: Column) -> Column:
    """How many parts hold a digit but end in no list of house numbers behind a street."""
    return F.size(F.filter(text_parts(text), lambda p: p.rlike("[0-9]") & read_part(p).isNull()))

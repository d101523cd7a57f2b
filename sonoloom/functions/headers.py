"""Column functions on header values: identifiers, dates, ages, names and text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the header model.
UNKNOWN, DEFAULT_DATE = "unknown", "19000101"
PATIENT_DIGITS, INSTANCE_DIGITS, DATE_SPAN = 10, 8, 31
DATE_SALT = "date-offset|"


def blank(c: Column) -> Column:
    """Null or empty."""
    return F.coalesce(c, F.lit("")) == ""


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; a trailing slash does not matter, an empty root changes nothing."""
    root = root.rstrip("/")
    return F.when(F.startswith(path, F.lit(root + "/")), F.substr(path, F.lit(len(root) + 2))).otherwise(path) if root else path


def output_path(path: Column, anon_name: Column, root: str, preserve_tree: bool) -> Column:
    """Where the anonymised file goes: its folder below the root and the new name, or the new name alone."""
    below = relative_path(path, root)
    folder = F.regexp_replace(below, r"[^/]*$", "")
    return F.concat(folder, anon_name) if preserve_tree else anon_name


def transducer_model(data: Column, manufacturer: Column, model: Column) -> Column:
    """Lower-case model; Butterfly devices name it in the model field, others in the transducer data."""
    source = F.when(F.contains(F.lower(F.coalesce(manufacturer, F.lit(""))), F.lit("butterfly")), model).otherwise(data)
    first = F.substring_index(F.substring_index(F.trim(source), "\\", 1), ",", 1)
    return F.coalesce(F.nullif(F.lower(F.trim(first)), F.lit("")), F.lit(UNKNOWN))


def hash_number(value: Column, modulus: int) -> Column:
    """SHA-256 of the text as one number, modulo ``modulus`` (at most 10^10): four parts of 64 bits, each cut into 28, 28 and 8 bits, which are
    multiplied by the residues of their place values, all in 64-bit arithmetic without a loop."""
    residue = lambda place: F.lit(pow(2, place, modulus)).cast("long")
    low = F.lit((1 << 28) - 1).cast("long")

    def of(parts: Column) -> Column:
        total = F.lit(0).cast("long")
        for i in range(4):
            part, place = parts[i], 64 * (3 - i)
            cut = part.bitwiseAND(low) * residue(place) + F.shiftrightunsigned(part, 28).bitwiseAND(low) * residue(place + 28) + F.shiftrightunsigned(part, 56) * residue(place + 56)
            total = total + cut % F.lit(modulus).cast("long")
        return total % F.lit(modulus).cast("long")

    split = lambda digest: F.transform(F.array(*(F.substring(digest, 16 * i + 1, 16) for i in range(4))), lambda x: F.conv(x, 16, -10).cast("long"))
    return F.transform(F.transform(F.array(F.sha2(value, 256)), split), of)[0]  # digest and parts are bound once, whatever the value's expression


def hash_uid(value: Column) -> Column:
    """A UID under the root for random ones, with 124 bits of the text's SHA-256 as its number."""
    number = lambda digest: F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)") * F.lit("18446744073709551616").cast("decimal(20,0)") + F.conv(F.substring(digest, 16, 16), 16, 10).cast("decimal(20,0)")
    return F.concat(F.lit("2.25."), F.transform(F.array(F.sha2(value, 256)), number)[0].cast("decimal(38,0)").cast("string"))


def hash_id(value: Column, digits: int) -> Column:
    """Zero-padded decimal hash of an identifier; empty for none."""
    return F.when(blank(value), F.lit("")).otherwise(F.lpad(hash_number(value, 10**digits).cast("string"), digits, "0"))


def plain_id(value: Column, digits: int) -> Column:
    """Unhashed identifier, padded but never cut."""
    return F.when(F.length(value) < digits, F.lpad(value, digits, "0")).otherwise(F.coalesce(value, F.lit("")))


def anon_filename(patient: Column, instance: Column, hashed: bool = True) -> Column:
    name = F.concat(hash_id(patient, PATIENT_DIGITS) if hashed else plain_id(patient, PATIENT_DIGITS), F.lit("_"), hash_id(instance, INSTANCE_DIGITS), F.lit(".dcm"))
    return F.when(blank(patient) | blank(instance), F.lit("")).otherwise(name)


def date_offset(patient: Column, salt: str = DATE_SALT) -> Column:
    """Days 0..30, one number per patient."""
    return hash_number(F.concat(F.lit(salt), F.coalesce(patient, F.lit(""))), DATE_SPAN).cast("int")


def shift_date(date: Column, offset: Column) -> Column:
    """``yyyyMMdd`` moved by ``offset`` days; missing is the default date, and what is no date stays as it is."""
    given = F.when(blank(date), F.lit(DEFAULT_DATE)).otherwise(date)
    parsed = F.when(given.rlike("^[0-9]{8}$"), F.try_to_timestamp(given, F.lit("yyyyMMdd")).cast("date"))
    return F.coalesce(F.date_format(F.date_add(parsed, offset), "yyyyMMdd"), given)


def cap_age(age: Column) -> Column:
    """Ages in years from 90 become 090Y."""
    years = F.when(age.rlike("^[0-9]{3}Y$"), F.substring(age, 1, 3).cast("int"))
    return F.when(years >= 90, F.lit("090Y")).otherwise(age)


def age_well_formed(age: Column) -> Column:
    return F.coalesce(age.rlike("^[0-9]{3}[DWMY]$"), F.lit(False))


def camel_to_snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"))


#: Fixed value: what counts as one word of a CamelCase name; digits stay with the word before them.
CAMEL_WORD = r"[A-Z][a-z\d]+|[A-Z\d]+(?=[A-Z][a-z\d]|[^a-zA-Z\d]|$)|[a-z\d]+"


def humanize(c: Column) -> Column:
    """CamelCase words, acronym runs kept together, joined by spaces."""
    return F.array_join(F.regexp_extract_all(c, F.lit(CAMEL_WORD), F.lit(0)), " ")


def pixel_spacing(delta_cm: Column) -> Column:
    """Millimetres as text with 14 decimals; null stays null."""
    return F.when(delta_cm.isNotNull(), F.format_string("%.14f", delta_cm * 10))

"""Type strings of C and C++: "*[5]const int" is a pointer to arrays of five constant integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of type strings.
QUALIFIERS = ("const", "volatile", "restrict")
STORAGE = ("extern", "static", "auto", "register")
STRINGS = ("string", "std::string")
SIGNED = {"char": 1, "int8_t": 1, "wchar_t": 4, "short int": 2, "int16_t": 2, "int": 4, "int32_t": 4, "long int": 8, "int64_t": 8}
UNSIGNED = {"unsigned char": 1, "uint8_t": 1, "unsigned short int": 2, "uint16_t": 2, "unsigned int": 4, "uint32_t": 4, "unsigned long int": 8, "uint64_t": 8, "size_t": 8}
FLOATS = {"float": 4, "double": 8}


def stripped(t: Column) -> Column:
    """Without the pointers and arrays at its beginning."""
    return F.regexp_replace(t, r"^(\*|\[[^\[\]]*\])+", "")


def pointer_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"\*"))


def array_dims(t: Column) -> Column:
    """Dimensions as texts; an open one is empty."""
    return F.transform(F.regexp_extract_all(t, F.lit(r"\[([^\[\]]*)\]"), 1), lambda d: d)


def _words(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, " "), stripped), lambda w: w != "")


def qualifiers(t: Column) -> Column:
    return F.filter(_words(t), lambda w: w.isin(*QUALIFIERS))


def storage_classes(t: Column) -> Column:
    return F.filter(_words(t), lambda w: w.isin(*STORAGE))


def base_words(t: Column) -> Column:
    """Specifiers that are neither qualifiers nor storage classes."""
    return F.filter(_words(t), lambda w: ~w.isin(*QUALIFIERS, *STORAGE))


def base_typename(t: Column) -> Column:
    return F.array_join(base_words(t), " ")


def is_pointer(t: Column) -> Column:
    return pointer_count(t) > 0


def is_array(t: Column) -> Column:
    return F.size(array_dims(t)) > 0


def is_c_string(t: Column) -> Column:
    """char, with either a pointer or an array, not both."""
    return (base_typename(t) == "char") & (is_pointer(t) != is_array(t))


def is_cpp_string(t: Column) -> Column:
    return base_typename(t).isin(*STRINGS) & ~is_pointer(t) & ~is_array(t)


def is_string(t: Column) -> Column:
    return is_c_string(t) | is_cpp_string(t)


def _sized(t: Column, sizes: dict[str, int]) -> Column:
    return F.coalesce(*(F.when(base_typename(t) == k, v) for k, v in sizes.items()))


def type_format(t: Column, print_strings: bool = False) -> Column:
    """Format of the values of a type; null for types that aren't traced."""
    base = base_typename(t)
    plain = F.when(is_pointer(t) | is_array(t), "POINTER").when(base.isin(*SIGNED), "SIGNED").when(base.isin(*UNSIGNED), "UNSIGNED").when(base.isin(*FLOATS), "FLOAT")
    return F.when(is_string(t), "BLOB").otherwise(plain) if print_strings else plain


def type_size(t: Column, print_strings: bool = False) -> Column:
    """Bytes of the values; 0 if they vary."""
    plain = F.when(is_pointer(t) | is_array(t), 8).otherwise(_sized(t, SIGNED | UNSIGNED | FLOATS))
    return F.when(is_string(t), 0).otherwise(plain) if print_strings else plain


def type_string(pointers: Column, dims: Column, specifiers: Column) -> Column:
    """The inverse: declarators before the first specifier, the others behind; numbers or nothing between brackets."""
    arrays = F.array_join(F.transform(dims, lambda d: F.concat(F.lit("["), F.when(d.rlike(r"^[0-9]+$"), d).otherwise(""), F.lit("]"))), "")
    return F.concat(F.repeat(F.lit("*"), pointers), arrays, F.array_join(specifiers, " "))


def is_traceable_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & ~name.startswith("__attribute")

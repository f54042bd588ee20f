"""URL identity: canonical form, domain and the rules that were applied, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, compared in lower case.
TRACKING_PARAMETERS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_cid", "utm_reader", "utm_place", "utm_brand", "utm_social",
    "gclid", "gclsrc", "dclid", "fbclid", "msclkid", "twclid", "igshid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "vero_id", "vero_conv", "yclid",
    "ref_src", "ref_url", "spm", "scm", "trk", "sc_channel", "sc_campaign", "s_kwcid", "ei", "ved", "usg", "sa", "oi", "ct", "cd", "cad", "source",
]
# Second-level labels below which names are registered.
SECOND_LEVELS = ["co", "com", "org", "net", "gov", "edu", "ac", "or", "ne", "go"]


def registrable_domain(domain: Column) -> Column:
    """The last two labels, or three where the last but one is a common second level below a two-letter one."""
    parts = F.split(domain, r"\.")
    n = F.size(parts)
    last, second = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    keep = F.when((n >= 3) & second.isin(SECOND_LEVELS) & (F.length(last) == 2), 3).otherwise(2)
    joined = F.array_join(F.slice(parts, F.greatest(n - keep + 1, F.lit(1)), keep), ".")
    return F.when(domain.isNull() | (domain == ""), F.lit(None).cast("string")).when(n <= 2, domain).otherwise(joined)


def schemeless(url: Column) -> Column:
    """The text after '://', or all of it."""
    return F.regexp_replace(url, r"^[^:/?#]*://", "")


def _decoded(part: Column) -> Column:
    """A query name or value without its escapes; a stray percent sign stands for itself."""
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(part: Column) -> Column:
    """Form encoding: letters, digits and _.-~ stay, a space is a plus sign."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonicalize_url(url: Column) -> Column:
    """struct<normalized_url, domain, scheme, rules>: host in ASCII without www, default port and credentials; no index
    page, trailing slash, tracking parameter or fragment (but one that begins with '!'); parameters sorted and encoded
    anew, blank ones kept. Only a string without any 'scheme:' gets http. http and https stay apart, and the path keeps
    its case. A URL that can't be used has a null normalized_url and the reason in rules: EMPTY, UNPARSEABLE,
    INVALID_HOST (mail addresses, scripts, hosts without a dot), INVALID_PORT. Null counts as empty."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    relative, bare = raw.startswith("//"), ~raw.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")
    full = F.when(relative, F.concat(F.lit("https:"), raw)).when(bare, F.concat(F.lit("http://"), raw)).otherwise(raw)
    part = lambda k: F.regexp_extract(full, r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k)
    scheme, authority, path, query, fragment = F.lower(part(1)), part(2), part(3), part(4), part(5)
    hostport = F.regexp_replace(authority, "^.*@", "")
    given = F.regexp_extract(hostport, r":([^:\]]*)$", 1)
    number = given.try_cast("int")
    host = F.lower(F.regexp_replace(hostport, r":[^:\]]*$", ""))
    bad_host = (host == "") | host.rlike(r"[\x20\t]") | (~F.contains(host, F.lit(".")) & (host != "localhost")) | host.rlike(r"^\.|\.$|\.\.")
    bad_port = (given != "") & (~given.rlike("^[0-9]+$") | number.isNull() | (number > 65535))
    # the JDK's own IDNA; a host that it refuses stays as it is
    ascii_host = F.when(host.rlike("[^\\x00-\\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host), host)).otherwise(host)
    dots = F.length(ascii_host) - F.length(F.replace(ascii_host, F.lit("."), F.lit("")))
    www = ascii_host.startswith("www.") & (dots > 1)
    domain = F.when(www, F.substring(ascii_host, 5, 1 << 20)).otherwise(ascii_host)
    default = F.when(scheme == "http", 80).when(scheme == "https", 443).when(scheme == "ftp", 21).otherwise(0)
    port = F.coalesce(number, F.lit(0))
    odd_port = (port != 0) & (port != default)
    plain = F.regexp_replace(path, r"(?i)/(?:index|default)\.(?:html?|php|aspx?)$", "/")
    trimmed = F.regexp_replace(plain, "/+$", "")
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).alias("v")))
    tracks = lambda p: F.lower(p["k"]).isin(TRACKING_PARAMETERS)
    kept = F.filter(pairs, lambda p: ~tracks(p))
    ordered = F.array_sort(kept)
    shown = F.array_join(F.transform(ordered, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    keep_fragment = fragment.startswith("!")
    normal = F.concat(
        scheme, F.lit("://"), domain, F.when(odd_port, F.concat(F.lit(":"), port.cast("string"))).otherwise(F.lit("")), F.when(trimmed == "", F.lit("/")).otherwise(trimmed),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), shown)).otherwise(F.lit("")), F.when(keep_fragment, F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )
    unpaired = F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]"))
    reason = F.when(raw == "", "EMPTY").when(unpaired, "UNPARSEABLE").when(bad_host, "INVALID_HOST").when(bad_port, "INVALID_PORT")
    rule = lambda when, what: F.when(when, F.lit(what) if isinstance(what, str) else what)
    dropped = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(pairs, tracks), lambda p: p["k"]))), ",")
    names = lambda c: F.transform(c, lambda p: p["k"])
    # fixed values: names of the rules, in the order in which they apply
    rules = F.array_compact(F.array(
        rule(relative, "protocol_relative->https"), rule(~relative & bare, "added_missing_scheme:http"), rule(ascii_host != host, "idna_encoded_host"), rule(www, "stripped_www"),
        rule((port != 0) & ~odd_port, "dropped_default_port"), rule(authority.rlike("^[^@:]+(?::.*)?@"), "stripped_userinfo"), rule(plain != path, "stripped_index_suffix"),
        rule((F.length(plain) > 1) & plain.endswith("/"), "stripped_trailing_slash"), rule(F.size(kept) < F.size(pairs), F.concat(F.lit("dropped_tracking_params:"), dropped)),
        rule(names(kept) != names(ordered), "sorted_query_params"), rule(keep_fragment, "kept_hashbang_fragment"), rule((fragment != "") & ~keep_fragment, "dropped_fragment"),
    ))
    ok = reason.isNull()
    return F.struct(F.when(ok, normal).alias("normalized_url"), F.when(ok, domain).alias("domain"), F.when(ok, scheme).alias("scheme"), F.when(ok, rules).otherwise(F.array(reason)).alias("rules"))

"""Browse URLs of repositories, files and lines: F23."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import strip

# Clone URL shapes, and per provider the tree / file / line URL parts.
HTTPS_CLONE = r"(?i)^https?://(?:[^@]+@)?([^/]+)/(.+?)(?:\.git)?/?$"
SSH_CLONE = r"^git@([^:]+):(.+?)(?:\.git)?/?$"
PUBLIC_HOSTS = ["github.com", "gitlab.com", "bitbucket.org"]
URL_PARTS = {
    "github": ("/tree/", "/blob/", "#L"),
    "gitlab": ("/-/tree/", "/-/blob/", "#L"),
    "bitbucket": ("/src/", "/src/", "#lines-"),
}


def web_base(url: Column) -> Column:
    """Clone URL to https://host/path, null when it has neither known shape."""
    u = strip(F.coalesce(url, F.lit("")))

    def path(pattern):
        return F.regexp_replace(F.regexp_extract(u, pattern, 2), "/+$", "")

    host = F.regexp_extract(u, SSH_CLONE, 1)
    public = F.coalesce(
        *[F.when(F.lower(host).contains(h), F.lit(h)) for h in PUBLIC_HOSTS], host
    )
    return F.when(
        u.rlike(HTTPS_CLONE),
        F.concat(F.lit("https://"), F.regexp_extract(u, HTTPS_CLONE, 1), F.lit("/"), path(HTTPS_CLONE)),
    ).when(
        u.rlike(SSH_CLONE), F.concat(F.lit("https://"), public, F.lit("/"), path(SSH_CLONE))
    )


def _quote(c: Column) -> Column:
    """Percent-encode all but unreserved characters."""
    encoded = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def source_url(
    url: Column, provider: Column, ref: Column, path: Column, line: Column
) -> Column:
    """Tree URL without a path, file URL with one, with a line anchor when line > 0."""
    base = web_base(url)
    kind = F.lower(F.trim(provider))
    ref_part = _quote(F.when(F.coalesce(ref, F.lit("")) == "", "HEAD").otherwise(ref))
    clean = F.replace(
        F.regexp_replace(strip(F.coalesce(path, F.lit(""))), "^/+", ""), F.lit("\\"), F.lit("/")
    )
    encoded = F.array_join(F.transform(F.split(clean, "/"), _quote), "/")
    no_file = strip(F.coalesce(path, F.lit(""))) == ""

    result = F.lit(None).cast("string")
    for name, (tree, blob, anchor) in URL_PARTS.items():
        mark = F.when(line > 0, F.concat(F.lit(anchor), line.cast("string"))).otherwise("")
        one = F.when(no_file, F.concat(base, F.lit(tree), ref_part)).otherwise(
            F.concat(base, F.lit(blob), ref_part, F.lit("/"), encoded, mark)
        )
        result = F.when(kind == name, one).otherwise(result)
    return result


def scan_ref(commit_sha: Column, branch: Column, default_branch: Column) -> Column:
    """Commit, branch or default branch of a scan, HEAD when none is known."""
    parts = [F.when(c != "", c) for c in (commit_sha, branch, default_branch)]
    return F.coalesce(*parts, F.lit("HEAD"))

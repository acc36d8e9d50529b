"""Column expressions over '/'-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """Path components. Also the ordering key: arrays compare element by element, which
    puts ``a/b.md`` before ``a-b.md`` where plain strings would not."""
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def rel_path(path: Column, root: str) -> Column:
    """Path below ``root``; a URI scheme and authority on either side is dropped."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?"
    bare = F.regexp_replace(path, scheme, "")
    prefix = F.length(F.regexp_replace(F.lit(root.rstrip("/")), scheme, ""))
    return F.substring(bare, prefix + 2, F.length(bare))


def path_stem(path: Column) -> Column:
    """File name without its last extension; a leading or trailing dot starts none."""
    return F.regexp_replace(base_name(path), r"(?s)(?<=.)\.[^.]+\z", "")


def role_name(path: Column) -> Column:
    """The component after the first ``roles``, otherwise the parent directory's name."""
    parts = components(path)
    at = F.array_position(parts, "roles").cast("int")
    return F.when(
        (at > 0) & (at < F.size(parts)), F.get(parts, at)
    ).otherwise(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))


def relative_link(target: Column, from_path: Column) -> Column:
    """Link to ``target`` as written inside the document ``from_path``."""
    to_parts = components(target)
    all_from = components(from_path)
    from_dir = F.slice(all_from, F.lit(1), F.size(all_from) - 1)
    same = F.zip_with(from_dir, to_parts, lambda a, b: a.eqNullSafe(b))
    first_diff = F.array_position(same, False).cast("int")
    shared = F.when(first_diff == 0, F.size(same)).otherwise(first_diff - 1)
    steps = F.concat(
        F.array_repeat(F.lit(".."), F.size(from_dir) - shared),
        F.slice(to_parts, shared + 1, F.size(to_parts)),
    )
    return F.when(F.size(steps) == 0, F.lit(".")).otherwise(F.array_join(steps, "/"))

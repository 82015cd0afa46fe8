"""Section titles: normal form, hierarchies, and the noise and method predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import strip

#: A title that contains one of these is noise.
NOISE = [
    "references", "bibliography", "reference", "acknowledgments", "acknowledgements", "acknowledgment", "acknowledgement", "appendix", "appendices", "biography", "biographies",
    "author contributions", "authors contributions", "author contribution", "contribution statement", "conflict of interest", "conflicts of interest", "competing interests",
    "declaration of interests", "funding", "financial support", "ethics statement", "ethics approval", "consent", "data availability", "code availability", "correspondence",
    "supplementary material", "supplementary information", "supplemental material", "abstract",
    "参考文献", "致谢", "作者贡献", "利益冲突", "资金支持", "基金资助", "伦理声明", "数据可用性", "代码可用性", "补充材料", "附录", "摘要",
]
#: Words of method sections; those in ASCII count between spaces only, the others anywhere.
METHOD = [
    "method", "methods", "methodology", "approach", "proposed method", "proposed approach", "materials and methods", "experimental methods", "model architecture", "implementation details",
    "方法", "方法学", "研究方法", "实验方法", "材料与方法", "模型架构", "实现细节",
]
#: The leading numbering of a title, what is trimmed from its ends, and the title of a chunk without one.
NUMBERING, EDGES, UNTITLED = r"^\s*[\divx]+[.):\- ]+", " .:-_()[]{}【】（）", "Document"


def normal_title(title: Column) -> Column:
    bare = F.regexp_replace(F.lower(strip(F.coalesce(title, F.lit("")))), NUMBERING, "")
    return F.btrim(F.regexp_replace(bare, r"(?U)\s+", " "), F.lit(EDGES))


def is_noise(title: Column) -> Column:
    return normal_title(title).rlike("|".join(NOISE))


def is_method(title: Column) -> Column:
    bounded = "|".join(k for k in METHOD if k.isascii())
    anywhere = "|".join(k for k in METHOD if not k.isascii())
    return normal_title(title).rlike(f"(^| )({bounded})( |$)|{anywhere}")


def _plain(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != "")


def hierarchy_parts(hierarchy: Column) -> Column:
    """The non-blank parts of "A > B > C"."""
    return _plain(F.split(F.coalesce(hierarchy, F.lit("")), ">"))


def listed_parts(hierarchy: Column) -> Column:
    """The non-blank parts of a hierarchy that is an array already."""
    return _plain(F.coalesce(hierarchy, F.array().cast("array<string>")))


def section_key(parts: Column, title: Column) -> Column:
    """What names a section: its hierarchy, or else its title."""
    return F.when(F.size(parts) > 0, F.array_join(parts, " > ")).otherwise(F.coalesce(F.nullif(strip(title), F.lit("")), F.lit(UNTITLED)))


def leaf_title(key: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.element_at(F.split(key, " > "), -1)), F.lit("")), F.lit(UNTITLED))


def any_part(parts: Column, title: Column, predicate) -> Column:
    """Whether the predicate holds for a title or for a part of its hierarchy."""
    return predicate(title) | F.exists(parts, predicate)


def with_headings(parts: Column, text: Column) -> Column:
    """A chunk's text after its headings, if it has more than one."""
    return F.when(F.size(parts) > 1, F.concat(F.lit("["), F.array_join(parts, " > "), F.lit("]\n"), text)).otherwise(text)

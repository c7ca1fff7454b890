"""Entities out of notes: which names count, their category, description, aliases, and the texts that stand for notes and entities when vectors are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherry.functions.exprs import file_stem
from wherry.operators import markdown as M

#: Names that are no entities (fixed values).
STOP_NAMES = ["me", "my", "i", "ok", "no", "yes", "hi", "hey", "mcp", "re", "cc", "id", "am", "pm", "vs", "etc"]
#: Forms of names that are no entities: dates, numbers, handles, tags, placeholders, file names (fixed values).
EXCLUDED = r"(?i)^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{4}$|^\d{4}-W\d{2}|^\d{4}-\d{2}|^\d{4}-Q\d|^\d+$|^@|^<|^\{\{|\\$|\.(?:md|js|py|json|jpg|png|pdf|csv)$|^[a-z0-9_-]+\.[a-z]+$"
#: Folders by the category they stand for (fixed values).
FOLDERS = {
    "people": ["people", "person", "contacts", "team", "members", "employees", "colleagues", "contractors", "consultants"],
    "organizations": ["companies", "organizations", "orgs", "clients", "customers", "vendors", "partners", "agencies", "institutions", "accounts"],
    "projects": ["projects", "project", "initiatives", "campaigns", "products", "goals", "deliverables", "work"],
    "locations": ["locations", "places"],
    "concepts": ["concepts", "topics", "knowledge", "research", "learning"],
    "technologies": ["tools", "software", "equipment", "tech", "apps", "platforms"],
    "media": ["media", "books", "films", "movies", "music", "podcasts", "reading", "articles"],
    "events": ["events", "meetings", "conferences"],
    "documents": ["documents", "docs", "templates", "guides", "references", "proposals", "admin", "archive", "resources"],
    "vehicles": ["vehicles"],
    "health": ["health", "fitness", "medical"],
    "finance": ["finance", "invoices", "billing"],
    "food": ["food", "recipes"],
    "hobbies": ["hobbies", "sports"],
    "animals": ["animals", "pets"],
    "periodical": ["daily-notes", "weekly-notes", "monthly-notes"],
}
#: Last words of organisations and places, and regions (fixed values).
ORG_WORDS = ["inc", "corp", "llc", "ltd", "team", "group", "co", "company"]
PLACE_WORDS = ["city", "county", "region", "district", "province"]
REGIONS = ["eu", "apac", "emea", "latam", "amer"]
#: Parts of names that make a technology (fixed values, a default; other lists are passed in).
TECH = [
    "databricks", "api", "code", "azure", "sql", "git", "node", "react", "powerbi", "excel", "copilot", "fabric", "apim", "endpoint", "synology", "tailscale", "obsidian", "claude", "powershell", "mcp", "typescript", "javascript", "python", "docker", "kubernetes", "adf", "adb", "net", "aws", "gcp", "terraform",
    "chatgpt", "langchain", "openai", "huggingface", "pytorch", "tensorflow", "anthropic", "llm", "embedding", "vector", "rag", "prompt", "agent", "transformer", "ollama", "gemini",
    "swift", "kotlin", "rust", "golang", "elixir", "scala", "julia", "ruby", "php", "csharp", "ansible", "nginx", "redis", "postgres", "mongodb", "graphql", "grpc", "kafka",
]


def declared_types(extra: dict[str, str] | None = None) -> dict[str, str]:
    """Categories by declared type: a category or a folder's name, in the plural or the singular; ``extra`` adds a vault's own types and wins."""
    out: dict[str, str] = {}
    for cat, names in FOLDERS.items():
        for n in (cat, *names):
            for t in (n, n.removesuffix("s"), n[:-3] + "y" if n.endswith("ies") else n):
                out.setdefault(t, cat)
    return out | (extra or {})


def declared_category(kind: Column, extra: dict[str, str] | None = None) -> Column:
    """Category of a declared type; null if it stands for none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in declared_types(extra).items() for x in pair]), F.lower(F.trim(kind)))


def is_entity_name(name: Column) -> Column:
    """Whether a note's name can be an entity's."""
    return (F.length(name) >= 2) & ~name.rlike(EXCLUDED) & ~F.lower(name).isin(*STOP_NAMES)


def scan(notes: DataFrame) -> DataFrame:
    """``name_lower, name, path`` for ``notes(path)``: file stems that can be entities, once each whatever their case; the smallest path counts."""
    n = notes.select("path", file_stem(F.col("path")).alias("name")).where(is_entity_name(F.col("name")))
    return n.groupBy(F.lower("name").alias("name_lower")).agg(F.min(F.struct("path", "name")).alias("x")).select("name_lower", "x.name", "x.path")


def folder_category(path: Column) -> Column:
    """Category of the first folder of a path that stands for one; null if none does."""
    pairs = [x for cat, names in FOLDERS.items() for n in names for x in (F.lit(n), F.lit(cat))]
    table = F.create_map(*pairs)
    hit = F.transform(F.split(F.lower(path), "/"), lambda s: F.try_element_at(table, s))
    return F.try_element_at(F.filter(hit, lambda x: x.isNotNull()), F.lit(1))


def category(name: Column, path: Column, declared: Column | None = None, tech: list[str] = TECH) -> Column:
    """The first of: declared type, folder, technology by a part of the name, acronym, organisation or place by the last word, two capitalised words a person, small letters a concept, several words a project, other."""
    low = F.lower(name)
    words = F.split(name, r"\s+")
    last = F.lower(F.element_at(words, -1))
    starts = lambda w: F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1))
    rest = (
        F.when(F.exists(F.array(*[F.lit(t) for t in tech]), lambda t: F.contains(low, t)), "technologies")
        .when((name == F.upper(name)) & F.length(name).between(2, 6), "acronyms")
        .when((F.size(words) >= 2) & last.isin(*ORG_WORDS), "organizations")
        .when(((F.size(words) >= 2) & last.isin(*PLACE_WORDS)) | low.isin(*REGIONS), "locations")
        .when((F.size(words) == 2) & starts(F.element_at(words, 1)) & starts(F.element_at(words, -1)), "people")
        .when((F.size(words) >= 2) & (name == low), "concepts")
        .when(F.contains(name, F.lit(" ")), "projects")
        .otherwise("other")
    )
    first = [c for c in (declared, folder_category(path)) if c is not None]
    return F.coalesce(*first, rest)


def description(text: Column) -> Column:
    """The frontmatter's ``description``, else the first paragraph of ten characters or more with markers and links unwrapped; 200 characters at most, null if there is none."""
    declared = F.trim(F.regexp_extract(M.front(text), r"(?m)^description:\s*['\"]?(.+?)['\"]?\s*$", 1))
    first = F.regexp_replace(F.split(F.regexp_replace(M.body(text), r"^\s+|\s+$", ""), r"\n\s*\n", 2)[0], r"^\s+|\s+$", "")
    plain = F.regexp_replace(F.regexp_replace(first, r"(?m)^#+\s+", ""), r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", "$1")
    return F.when(declared != "", F.substring(declared, 1, 200)).when(F.length(first) >= 10, F.substring(F.trim(plain), 1, 200))


def front_list(text: Column, field: str) -> Column:
    """A frontmatter field as a list of strings: an array in brackets or a single value, quotes and ``#`` removed; empty if it is absent."""
    raw = F.regexp_extract(M.front(text), rf"(?m)^{field}:[ \t]*\[?([^\]\n]*)\]?[ \t]*$", 1)
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"'#]+|[\"']+$", "")), lambda x: x != "")


def search_front(text: Column) -> Column:
    """Frontmatter for searching: values without their keys, lines that begin with a bracket or brace left out."""
    lines = F.transform(F.split(M.front(text), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\s-]*", ""), r"^\w+:\s*", ""))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("[")) & ~F.startswith(x, F.lit("{"))), " ")


def note_text(text: Column, path: Column) -> Column:
    """What stands for a note when its vector is made: its title, up to five tags, and its body."""
    tags = F.slice(front_list(text, "tags"), 1, 5)
    head = F.concat(F.lit("Note: "), file_stem(path), F.when(F.size(tags) > 0, F.concat(F.lit(". Tags: "), F.array_join(tags, ", "))).otherwise(F.lit("")))
    return F.concat(head, F.lit(".\n\n"), M.body(text))


def entity_text(name: Column, aliases: Column, cat: Column, content: Column) -> Column:
    """What stands for an entity: its name twice, aliases, category, and the first 500 characters of its note."""
    return F.concat_ws(" ", name, name, F.when(F.size(aliases) > 0, F.array_join(aliases, " ")), cat, F.substring(content, 1, 500))

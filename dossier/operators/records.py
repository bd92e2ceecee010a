"""Nested records read from the markdown of one person. Column expressions alone: nothing is shuffled, no value fails."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels as L
from ..functions import text as T

#: A line of a company: name, start, end and, in brackets, how long (fixed pattern).
#: It begins where the line does: a search from every place would find no more, in the square of the time.
COMPANY = rf"^(.+?){T.SPACE}*,{T.SPACE}*(\d{{4}}/\d{{2}}/\d{{2}}){T.SPACE}*~{T.SPACE}*(\S+){T.SPACE}*\(([^)]+)\)"
SEPARATORS = "[,，、]"
PAIRS = "array<struct<key:string,value:string>>"
#: Text columns and list columns of a record, in the order of the stored table.
TEXTS = (
    "name", "english_name", "code", "birth_year", "age", "nationality", "current_status", "earliest_start", "education_level",
    "school", "major", "military_status", "desired_salary", "desired_industry", "years_of_experience", "linkedin_url", "photo_path",
    "email", "mobile1", "mobile2", "phone_home", "phone_work", "district", "mailing_address", "work_type", "shift_preference",
    "remote_work_preference", "skills_text", "self_introduction",
)
LISTS = ("desired_job_categories", "desired_locations", "ideal_positions", "skill_tags")
CHILDREN = {
    "work": "array<struct<seq:int,company_name:string,date_start:string,date_end:string,duration:string,industry:string,company_size:string,job_category:string,management_responsibility:string,job_title:string,job_description:string,job_skills:string>>",
    "education": "array<struct<seq:int,school:string,department:string,degree_level:string,date_start:string,date_end:string,region:string,status:string>>",
    "references": "array<struct<ref_name:string,ref_email:string,ref_org:string,ref_title:string>>",
    "attachments": "array<struct<attachment_type:string,seq:int,name:string,description:string,url:string>>",
}


def held(c: Column) -> Column:
    """``c``, kept apart from what is asked of it later.

    The optimizer would write the steps of a parser into each filter on their
    result, and reason about every step for each join, at a cost that doubles
    from step to step. It does neither with columns that are not deterministic;
    this condition isn't in its eyes, and always holds.
    """
    return F.when(F.spark_partition_id() >= 0, c)


class _Steps:
    """Projections to be made one after the other: columns that are added, or names that are dropped."""

    def __init__(self) -> None:
        self.steps: list[dict[str, Column] | tuple[str, ...]] = []

    def drop(self, *names: str) -> _Steps:
        self.steps.append(names)
        return self

    def applied(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.withColumns(step) if isinstance(step, dict) else df.drop(*step)
        return df


def _with(at: _Steps, columns: dict[str, Column]) -> _Steps:
    at.steps.append({n: held(c) for n, c in columns.items()})
    return at


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether ``c`` contains one of the words; it is computed once."""
    return T.bound(c, lambda x: T.holds(x, words))


def _by_name(parts: Column, names: tuple[str, ...]) -> Column:
    """Body of the section with the first of ``names`` that exists; "" without one."""
    return F.coalesce(*[F.get(F.filter(parts, lambda s: s["name"] == n), 0)["body"] for n in names], F.lit(""))


def _nameless(pairs: Column) -> Column:
    one, two = (T.first_value(pairs, k) for k in L.NAME)
    return (one == "") & (two == "")


def with_basic(df: _Steps, section: str, rows: str, out: str) -> _Steps:
    """``out``: map of the basic section's keys; the first value of a key counts.

    Where the table has no name, pairs of the running text fill in what is
    missing or empty; where there is still none, those of the text after line
    breaks in cells are opened.
    """
    body, none = F.col(section), _none(PAIRS)
    opened = F.regexp_replace(F.regexp_replace(body, rf"{T.UNICODE}<br{T.SPACE}*/?>", "\n"), r"\|", " ")
    flat = lambda c: T.keys_in_text(T.running_text(c), L.BASIC_KEYS)
    df = _with(df, {"_kv": T.last_of_each(T.key_values(F.col(rows)))})
    df = _with(df, {"_more": F.when(_nameless(F.col("_kv")), flat(body)).otherwise(none)})
    df = _with(df, {"_kv": F.when(F.size("_more") > 0, T.first_of_each(T.filled(F.col("_kv"), F.col("_more")))).otherwise(F.col("_kv"))})
    df = _with(df, {"_more": F.when(_nameless(F.col("_kv")), flat(opened)).otherwise(none)})
    return _with(df, {out: T.key_map(T.filled(F.col("_kv"), F.col("_more")))}).drop("_kv", "_more")


def person_name(section: Column, rows: Column, pairs: Column) -> Column:
    """The name without its sign of gender; where keys give none, from four other layouts."""
    signless = lambda c: T.strip(F.regexp_replace(c, rf"{T.UNICODE}{T.SPACE}*[♂♀]{T.SPACE}*", ""))
    keyed = signless(F.get(F.split(T.at_key(pairs, *L.NAME), T.alternatives((*L.ENGLISH_NAME, L.CODE))), 0))
    colon, rest = rf"{T.SPACE}*[:：]{T.SPACE}*", r"([^♂♀\n|*:：]+)"
    bold = rf"姓\*{{0,2}}[/／]\*{{0,2}}名\*{{0,2}}{colon}\*{{0,2}}{T.SPACE}*{rest}"
    plain = rf"姓名{colon}{rest}"
    signed = F.get(
        F.filter(rows, lambda r: (F.size(r) >= 2) & F.get(r, F.lit(0)).rlike("[♂♀]") & _any(F.get(r, F.lit(1)), (*L.ENGLISH_NAME, L.CODE))), 0
    )
    piped = T.strip(T.found(section, rf"^\|{T.SPACE}*((?!{T.SPACE})[^|][^|]*?){T.SPACE}*\|{{1,2}}{T.SPACE}*$", T.LINES))
    piped = F.when((F.length(piped) <= 30) & ~piped.rlike("[:：]"), piped).otherwise("")
    beside = F.coalesce(signless(F.get(signed, F.lit(0))), F.lit(""))
    loose = (
        F.when(section.rlike(T.UNICODE + bold), T.strip(T.found(section, bold)))
        .when(section.rlike(T.UNICODE + plain), T.strip(T.found(section, plain)))
        .when(beside != "", beside)
        .otherwise(piped)
    )
    return T.strip(F.replace(F.when(keyed != "", keyed).otherwise(loose), F.lit("|"), F.lit("")))


def person_code(section: Column, pairs: Column) -> Column:
    """Leading digits of the code; without a value beside the key, from the raw section."""
    keyed = T.at_key(pairs, L.CODE)
    raw = T.found(section, rf"104\*{{0,2}}代碼\*{{0,2}}{T.SPACE}*[:：]{T.SPACE}*\*{{0,2}}{T.SPACE}*(\d+)")
    return T.found(F.when(keyed != "", keyed).otherwise(raw), r"^(\d+)")


def birth_and_age(text: Column) -> tuple[Column, Column]:
    """``2002(24)`` gives both; any other text is given for both."""
    both = rf"^(\d{{4}}){T.SPACE}*\((\d+)\)"
    has = text.rlike(T.UNICODE + both)
    year = F.when(has, T.found(text, both)).otherwise(text)
    return year, F.when(has, F.regexp_extract(text, T.UNICODE + both, 2)).otherwise(text)


def job_categories(rows: Column) -> Column:
    """Values beside the key in its row, joined and parted again; signs that stand alone are left out."""
    key = L.JOB_CATEGORIES
    row = F.coalesce(F.get(F.filter(rows, lambda r: F.exists(r, lambda c: c.contains(key))), 0), _none("array<string>"))
    at = F.array_position(F.transform(row, lambda c: c.contains(key)), True).cast("int")
    after = F.filter(F.slice(row, F.greatest(at, F.lit(1)), F.size(row)), lambda c: ~c.contains(key) & (c != "") & ~c.rlike("[:：]$"))
    return F.filter(T.pieces(F.array_join(after, ", "), SEPARATORS), lambda x: F.length(x) > 1)


def profile_link(section: Column) -> Column:
    """A labelled profile link, else any; without closing brackets, marks of escape undone."""
    flags = "(?iU)"
    labelled = rf"linkedin:{T.SPACE}*\[?(https?://[^\s\x1c-\x1f\]]+)"
    link = F.when(section.rlike(flags + labelled), T.found(section, labelled, flags)).otherwise(
        T.found(section, r"(https?://(?:www\.)?linkedin\.com/[^\s\x1c-\x1f\]]+)", flags)
    )
    return F.replace(F.regexp_replace(link, r"\)+$", ""), F.lit("\\_"), F.lit("_"))


def summary(section: Column, ends: tuple[str, ...] = L.AFTER_SUMMARY) -> Column:
    """The personal summary in the basic section, up to what may follow it."""
    body = rf"\Q{L.SUMMARY}\E\*{{0,2}}[:：]\*{{0,2}}{T.SPACE}*(.*?)(?={T.alternatives(ends)}|#|\n?\z)"
    return T.strip(T.found(section, body, "(?dsU)"))


def company_starts(joined: Column) -> Column:
    """Positions of texts that open a work entry."""
    return F.filter(F.transform(joined, lambda x, i: F.when(x.contains("~") & x.contains("(") & x.rlike(T.UNICODE + COMPANY), i)), lambda x: x.isNotNull())


def work_entries(opening: Column, starts: Column, pairs: Column, carried: Column | None = None) -> Column:
    """A numbered entry for each opening text with the pairs that follow it.

    ``opening`` are all texts in order, ``pairs`` the pairs of each, and
    ``carried`` is put before those of the first entry. The last value of a
    field counts; of description and skills only those with text. Pass columns
    that are computed already: they are read once for each entry.
    """

    def entry(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(opening))
        line = F.get(opening, start)
        own = F.flatten(F.slice(pairs, start + 2, F.greatest(end - start - 1, F.lit(0))))
        if carried is not None:
            own = F.when(k == 0, F.concat(carried, own)).otherwise(own)
        maps = F.struct(T.key_map(own, last=True).alias("any"), T.key_map(F.filter(own, lambda x: x["value"] != ""), last=True).alias("text"))
        return T.bound(
            maps,
            lambda m: F.struct(
                (k + 1).cast("int").alias("seq"),
                T.strip(T.found(line, COMPANY)).alias("company_name"),
                *[F.regexp_extract(line, T.UNICODE + COMPANY, g).alias(n) for g, n in ((2, "date_start"), (3, "date_end"), (4, "duration"))],
                *[T.at_key(m["any"], *keys).alias(n) for n, keys in L.WORK_FIELDS.items()],
                *[T.at_key(m["text"], *keys[::-1]).alias(n) for n, keys in L.WORK_TEXTS.items()],
            ),
        )

    return F.transform(starts, entry)


def education_entries(rows: Column) -> Column:
    """Rows that begin with a number and a point, seven cells each; header rows are skipped."""

    def entry(r: Column) -> Column:
        cell = lambda k: F.coalesce(F.get(r, F.lit(k)), F.lit(""))
        full_width = F.translate(F.regexp_replace(cell(0), r"\.+$", ""), "０１２３４５６７８９", "0123456789")
        period = rf"^(\d{{4}}/\d{{2}}/\d{{2}}){T.SPACE}*~{T.SPACE}*(\d{{4}}/\d{{2}}/\d{{2}})"
        return F.struct(
            F.coalesce(F.when(full_width.rlike(r"^\d+$"), full_width.try_cast("int")), F.lit(0)).alias("seq"),
            cell(1).alias("school"),
            cell(2).alias("department"),
            cell(3).alias("degree_level"),
            T.found(cell(4), period).alias("date_start"),
            F.regexp_extract(cell(4), T.UNICODE + period, 2).alias("date_end"),
            cell(5).alias("region"),
            cell(6).alias("status"),
        )

    header = lambda r: F.exists(r, lambda c: c.isin(*L.EDUCATION_HEADERS))
    numbered = lambda r: F.coalesce(F.get(r, F.lit(0)).rlike(rf"{T.UNICODE}^\d+\."), F.lit(False))
    return F.transform(F.filter(rows, lambda r: ~header(r) & numbered(r)), entry)


def recovered_work(section: Column, md: Column) -> Column:
    """The work section; where it is under 50 signs, all from its heading to that of skills or introduction."""
    start = rf"^#{{1,4}}{T.SPACE}+[⼯工]作經驗"
    end = rf"^#{{1,4}}{T.SPACE}+(?:才能專[⻑長]|⾃我介紹|自我介紹)"
    again = (F.length(section) < 50) & md.rlike(T.LINES + start)
    return F.when(again, T.found(md, rf"{start}(.*?)(?={end}|\z)", "(?dmsU)")).otherwise(section)


def skills_block(md: Column) -> Column:
    """From the skills heading, that included, to the heading of the introduction or the end."""
    flags = "(?dmsU)"
    starts = [rf"^#{{1,4}}{T.SPACE}+{w}" for w in L.SKILLS]
    ends = [rf"^#{{1,2}}{T.SPACE}+{w}" for w in L.INTRODUCTION]

    def block(start: str) -> Column:
        out = T.found(md, rf"({start}.*)\z", flags)
        for end in reversed(ends):
            out = F.when(md.rlike(rf"{flags}{start}.*{end}"), T.found(md, rf"({start}.*?)(?={end})", flags)).otherwise(out)
        return out

    return T.strip(F.when(md.rlike(flags + starts[0]), block(starts[0])).otherwise(block(starts[1])))


def attachment_entries(rows: Column) -> Column:
    """Numbered rows under the labels of references or attachments, numbered anew; others are dropped."""
    labels = ((L.REFERENCES, "ref"), ((L.ATTACHMENTS,), "att"), ((L.PROJECTS,), "project"), ((L.OTHER_WORKS,), "other"))
    number = rf"{T.UNICODE}^\d+\.$"

    def kind(r: Column) -> Column:
        one = lambda joined: F.coalesce(*[F.when(T.holds(joined, words), F.lit(mode)) for words, mode in reversed(labels)])
        return T.bound(F.array_join(r, " "), one)

    def step(acc: Column, r: Column) -> Column:
        mode = F.coalesce(kind(r), acc["mode"])
        header = F.exists(r, lambda c: c.isin(*L.ATTACHMENT_HEADERS))
        counts = mode.isin("ref", "att") & ~header & F.exists(r, lambda c: c.rlike(number))
        own = F.filter(r, lambda c: (c != "") & ~c.rlike(number) & ~c.isin(*L.REFERENCES, L.ATTACHMENTS))
        entry = F.struct(
            F.lit(L.ATTACHMENTS).alias("attachment_type"),
            (F.size(acc["out"]) + 1).alias("seq"),
            F.coalesce(F.get(own, F.lit(0)), F.lit("")).alias("name"),
            F.lit("").alias("description"),
            F.coalesce(F.get(own, F.lit(1)), F.lit("")).alias("url"),
        )
        return F.struct(mode.alias("mode"), F.when(counts, F.array_append(acc["out"], entry)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit("").alias("mode"), _none(CHILDREN["attachments"]).alias("out"))
    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def parse_records(df: DataFrame, text_col: str = "markdown", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and the whole record of each text: TEXTS, LISTS and CHILDREN.

    Only what is selected of the record is computed: a query for names reads the
    basic section alone. Time grows with a text's length, and a little more for
    sorting its keys.

    What is missing is "" or an empty list; references are always empty. A null
    text gives an empty record. A bare bar gives a row without cells, which is
    skipped.
    """
    keep = keep or []
    steps, fields = _parser(df.sparkSession.sparkContext)
    # Kept columns travel as one, so that none can clash with a step's.
    at = df.select(F.struct(*keep).alias("_kept") if keep else F.lit(0).alias("_kept"), held(F.coalesce(F.col(text_col), F.lit(""))).alias("_md"))
    # Each field is held by itself: what isn't asked for is not computed, down to the sections that it alone needs.
    return steps.applied(at).select(*[F.col(f"_kept.`{c}`").alias(c) for c in keep], *[c.alias(n) for n, c in fields.items()])


@lru_cache(maxsize=1)
def _parser(context: SparkContext) -> tuple[_Steps, dict[str, Column]]:
    """Steps from _md on and the record's fields after them. Made once for a session's context: so many expressions take seconds."""
    # Each step is a projection of its own, so that no step is computed again for every use.
    at = _Steps()
    at = _with(at, {"_names": T.headings(F.col("_md")), "_bodies": T.bodies(F.col("_md")), "_plain": T.only_newlines(F.col("_md"))})
    at = _with(at, {"_parts": T.sections(F.col("_names"), F.col("_bodies"))}).drop("_names", "_bodies")
    parts, md, plain = F.col("_parts"), F.col("_md"), F.col("_plain")
    has_basic = F.exists(parts, lambda s: s["name"] == L.BASIC)
    at = _with(at, {"_basic": F.when(has_basic, _by_name(parts, (L.BASIC,))).otherwise(_by_name(parts, ("_preamble",)))})
    named = _by_name(parts, L.CONTACT)
    glued = F.get(F.filter(parts, lambda s: s["name"].rlike(f"^(?:{T.alternatives(L.CONTACT)})")), 0)
    glued = F.coalesce(F.concat(glued["name"], F.lit(" "), glued["body"]), F.lit(""))
    wishes = F.get(F.filter(parts, lambda s: T.holds(s["body"], L.PREFERENCES)), 0)["body"]
    at = _with(
        at,
        {
            "_contact": F.when(named != "", named).when(glued != "", glued).otherwise(F.col("_basic")),
            "_work": recovered_work(_by_name(parts, L.WORK), md),
            "_wishes": F.coalesce(wishes, F.lit("")),
            "_skills": skills_block(md),
            "_intro": _by_name(parts, L.INTRODUCTION),
        }
    )
    # The first section whose table has one of the labels in its first column; only those that hold one at all are read as tables.
    labelled = F.filter(parts, lambda s: T.holds(s["body"], (*L.REFERENCES, L.ATTACHMENTS)))
    at = _with(at, {"_tables": F.transform(labelled, lambda s: T.table_rows(s["body"], plain))})
    first_cells = lambda rows: F.array_join(F.transform(rows, lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit(""))), " ")
    tables = F.filter("_tables", lambda rows: _any(first_cells(rows), (*L.REFERENCES, L.ATTACHMENTS)))
    education = F.when(F.contains("_work", F.lit(L.EDUCATION)), T.found(F.col("_work"), rf"({L.EDUCATION}.*)\z", "(?s)")).otherwise(F.col("_work"))
    at = _with(
        at,
        {
            "_attached": F.coalesce(F.get(tables, 0), _none("array<array<string>>")),
            "_basic_rows": T.table_rows(F.col("_basic")),
            "_contact_rows": T.table_rows(F.col("_contact"), plain),
            "_work_rows": T.table_rows(F.col("_work"), plain),
            "_education_rows": F.size(T.barred(education, plain)),
            "_wishes": T.key_map(T.key_values(T.table_rows(F.col("_wishes"), plain)), last=True),
        }
    ).drop("_parts", "_tables", "_md")
    # The table of schools ends the section of work, so its rows are the last of those: none is cut into cells again.
    n = F.col("_education_rows")
    at = _with(at, {"_education_rows": F.slice("_work_rows", F.size("_work_rows") - n + 1, n)})
    at = with_basic(at, "_basic", "_basic_rows", "_pairs")
    at = _with(at, {"_contacts": T.last_of_each(T.key_values(F.col("_contact_rows")))})
    flat = T.keys_in_text(F.replace(F.col("_contact"), F.lit("**"), F.lit("")), L.CONTACT_KEYS)
    more = F.when(T.first_value(F.col("_contacts"), "email") == "", F.concat("_contacts", flat)).otherwise(F.col("_contacts"))
    at = _with(at, {"_contacts": T.key_map(more)})
    joined = F.transform("_work_rows", lambda r: F.array_join(r, " "))
    none = _none("array<int>")
    at = _with(at, {"_joined": joined})
    at = _with(at, {"_starts": company_starts(F.col("_joined"))})
    by_rows = F.size("_starts") > 0
    # Entries are in rows or in lines; the other form is not read. A row without a colon, as of schools, has no key.
    row_pairs = F.transform("_work_rows", lambda r, i: F.when(T.has_colon(F.get("_joined", i)), T.key_values(F.array(r))).otherwise(_none(PAIRS)))
    work_lines = F.filter(F.transform(T.lines(F.replace(F.col("_work"), F.lit("**"), F.lit("")), plain), T.strip), lambda x: x != "")
    at = _with(
        at,
        {
            "_row_pairs": F.when(by_rows, row_pairs).otherwise(_none(f"array<{PAIRS}>")),
            "_work_lines": F.when(by_rows, _none("array<string>")).otherwise(work_lines),
        },
    )
    at = _with(at, {"_line_starts": F.when(by_rows, none).otherwise(company_starts(F.col("_work_lines")))})
    by_lines = F.size("_line_starts") > 0
    line_pairs = F.transform("_work_lines", lambda x: F.when(T.has_colon(x), T.keys_in_text(x, L.WORK_KEYS)).otherwise(_none(PAIRS)))
    at = _with(at, {"_line_pairs": F.when(by_lines, line_pairs).otherwise(_none(f"array<{PAIRS}>"))})
    before = F.flatten(F.slice("_line_pairs", F.lit(1), F.coalesce(F.get("_line_starts", F.lit(0)), F.lit(0))))
    at = _with(at, {"_before": before})
    work = F.when(by_rows, work_entries(F.col("_joined"), F.col("_starts"), F.col("_row_pairs"))).otherwise(
        work_entries(F.col("_work_lines"), F.col("_line_starts"), F.col("_line_pairs"), F.col("_before"))
    )
    basic, pairs, contacts = F.col("_basic"), F.col("_pairs"), F.col("_contacts")
    year, age = birth_and_age(T.at_key(pairs, L.AGE))
    own = summary(basic)
    intro = T.strip(F.regexp_replace("_intro", rf"(?dU)#{{1,4}}{T.SPACE}+.+", ""))
    introduction = F.when(own != "", own).when(intro != "", intro).otherwise(summary(basic, L.AFTER_SUMMARY[:2]))
    fields = {
        "name": person_name(basic, F.col("_basic_rows"), pairs),
        "english_name": T.at_key(pairs, *L.ENGLISH_NAME),
        "code": person_code(basic, pairs),
        "birth_year": year,
        "age": age,
        **{n: T.at_key(pairs, *keys) for n, keys in L.SCALARS.items()},
        "linkedin_url": profile_link(basic),
        "photo_path": T.found(basic, r"!\[.*?\]\(([^)]+)\)", "(?d)"),
        **{n: T.at_key(contacts, *keys) for n, keys in L.CONTACTS.items()},
        **{n: T.at_key(F.col("_wishes"), *keys) for n, keys in L.WISHES.items()},
        "skills_text": F.col("_skills"),
        "self_introduction": introduction,
        "desired_job_categories": job_categories(F.col("_basic_rows")),
        "desired_locations": T.pieces(T.at_key(pairs, *L.LOCATIONS), SEPARATORS),
        "ideal_positions": T.pieces(T.at_key(pairs, L.IDEAL_POSITIONS), rf"{T.SPACE}{{2,}}|[,，、\n]"),
        "skill_tags": T.hashtags(F.col("_skills")),
        "work": work,
        "education": education_entries(F.col("_education_rows")),
        "references": _none(CHILDREN["references"]),
        "attachments": attachment_entries(F.col("_attached")),
    }
    kinds = dict.fromkeys(TEXTS, "string") | dict.fromkeys(LISTS, "array<string>") | CHILDREN
    return at, {n: held(fields[n].cast(kind)) for n, kind in kinds.items()}


def childless(df: DataFrame, text_col: str = "markdown", keep: list[str] | None = None) -> DataFrame:
    """``keep``, name and code of each text, and whether it has neither nor any child row (_bare).

    Children are read of texts without a name and a code only, so most texts
    cost their basic section.
    """
    keep = keep or []
    at = df.select(F.struct(*keep).alias("_own") if keep else F.lit(0).alias("_own"), F.col(text_col).alias("_text"))
    named = parse_records(at, "_text", ["_own", "_text"]).select("_own", "_text", "name", "code")
    nameless = (F.col("name") == "") & (F.col("code") == "")
    rest = named.select(F.struct("_own", "name", "code").alias("_first"), F.when(nameless, F.col("_text")).alias("_text"), nameless.alias("_nameless"))
    found = parse_records(rest, "_text", ["_first", "_nameless"])
    bare = F.col("_nameless")
    for c in CHILDREN:
        bare = bare & (F.size(c) == 0)
    return found.select(*[F.col(f"_first._own.`{c}`").alias(c) for c in keep], F.col("_first.name").alias("name"), F.col("_first.code").alias("code"), bare.alias("_bare"))


def split_people(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each person's part of each document, numbered from 0."""
    return df.select(*(keep or []), F.posexplode(T.split_documents(F.col(text_col), L.BASIC)).alias("part", "markdown"))


def named_parts(parts: DataFrame) -> DataFrame:
    """Rows of ``split_people`` with the name and the folder under which a part is stored, numbered from 1."""
    name = T.log_name(F.col("markdown"), F.col("part") + 1, L.NAME[0])
    safe = T.safe_name(name, "candidate")
    return parts.withColumns({"log_name": name, "folder": F.concat(F.lit("candidate_"), (F.col("part") + 1).cast("string"), F.lit("_"), safe)})


def imported(df: DataFrame, list_columns: list[str]) -> DataFrame:
    """Stored rows as records: null texts become "", encoded lists become arrays."""
    return df.select(*[(T.decode_list(F.col(c)) if c in list_columns else F.coalesce(F.col(c), F.lit("")) if t == "string" else F.col(c)).alias(c) for c, t in df.dtypes])

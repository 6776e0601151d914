"""Chat formatting: a finite-state machine over roles, a declarative template, text segments with loss flags.

The template is data: for each role how a turn opens and closes and whether its text is learned, and which role may
follow which. Inside texts every control string is escaped reversibly, so that a text can never open or close a turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn reads: open, role, newline, text, close. `loss` lists the roles whose text is learned.

    `moves` is the state machine: state -> role -> next state; a pair that is missing leads to `reject`, where it stays.
    """

    open: str = "<s>"
    close: str = "</s>\n"
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("user", "assistant")
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    #: Further strings that a text must not hold as they stand, besides `open` and `close`.
    controls: tuple[str, ...] = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def __post_init__(self) -> None:
        for c in self.guarded():
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"control string {c!r}: at least two characters and no backslash are needed to escape it")
        if any(self.close.startswith(self.close[-k:]) for k in range(1, len(self.close))):
            raise ValueError(f"close {self.close!r} ends as it begins, so a text's end and it could be mistaken")
        if any(self.close.startswith(self.open[-k:]) for k in range(1, len(self.open) + 1)):
            raise ValueError(f"open {self.open!r} ends as close {self.close!r} begins, so a role could complete it")

    def guarded(self) -> list[str]:
        """Every control string, the white space around `open` and `close` left out."""
        return sorted({self.open.strip(), self.close.strip(), *self.controls})


DEFAULT = Template()
#: A line end in a role. No role gives this by itself, since its own backslashes are doubled.
NEWLINE = "<\\n>"


def escape(c: Column, template: Template = DEFAULT) -> Column:
    """Doubles backslashes, then puts one after the first character wherever a control string of the template begins."""
    begins = "|".join(f"{_quote(s[0])}(?={_quote(s[1:])})" for s in template.guarded())
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), begins, r"$0\\")


def unescape(c: Column) -> Column:
    """Undoes `escape`: a text's own backslashes come in pairs, those put in are single."""
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def valid_order(roles: Column, template: Template = DEFAULT) -> Column:
    """True if the machine accepts the roles; no turns at all are not accepted."""
    step = F.create_map(*[F.lit(x) for s, m in template.moves.items() for r, to in m.items() for x in (f"{s}\n{r}", to)])
    end = F.aggregate(roles, F.lit(template.start), lambda s, r: F.coalesce(F.try_element_at(step, F.concat(s, F.lit("\n"), r)), F.lit("reject")))
    return end.isin(*template.accept)


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """turns: conv_id, turn, role, text, and whatever else, which is not read.

    One row per conv_id: `valid` (turn order accepted), `segments` array of struct(text, loss) whose texts joined are
    `formatted`, and `formatted`. Conversations with a turn order that the machine rejects are formatted too, marked
    not valid. Turns come in the order of turn, then role, then text; rows that repeat stay. A null text or role is
    empty, a null turn comes first, a null conv_id is a conversation of its own. A newline in a role is escaped. An
    empty table gives no rows. A conversation is one text, so it is gathered whole.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    grouped = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(template.open), F.replace(escape(t["role"], template), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
        seg = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        return F.array(seg(head, F.lit(False)), seg(escape(t["text"], template), t["role"].isin(*template.loss)), seg(F.lit(template.close), F.lit(False)))

    out = grouped.select("conv_id", valid_order(F.transform("t", lambda t: t["role"]), template).alias("valid"), F.flatten(F.transform("t", parts)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Adds `turns`, array of struct(role, text) parsed from `formatted` alone, texts unescaped."""
    pieces = F.split("formatted", F.lit(_quote(template.close)))
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(template.open) + 1))
        cut = F.locate("\n", body)
        name = F.substr(body, F.lit(1), cut - 1)
        return F.struct(unescape(F.replace(name, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    return formatted.withColumn("turns", F.transform(bodies, turn))


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def conversation_digests(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The digest columns of op9, all derived from the formatted text and the loss flags of its segments."""
    back = read_back(format_conversations(turns, template), template)
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", "valid", "formatted", F.size("turns").cast("long").alias("n_turns"), spoken.alias("spoken"), learned.alias("learned")).select(
        "conv_id",
        "n_turns",
        F.sha2("spoken", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )

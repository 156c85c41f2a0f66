"""Values of arithmetic expressions in text: a stack machine over their tokens, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens, how tightly operators bind, and words that may stand before an expression.
TOKENS = r"(\d+(?:\.\d+)?|[+\-*/%^()]|sqrt|abs)"
BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "^": 3, "neg": 4}
CALLS = ("sqrt", "abs")
BEFORE = r"^(?:what is |compute |calculate |evaluate )"


def tokens(text: Column) -> Column:
    plain = F.rtrim(F.regexp_replace(F.lower(text), BEFORE, ""), F.lit(" ?.!"))
    return F.regexp_extract_all(F.replace(F.replace(plain, F.lit("**"), F.lit("^")), F.lit(","), F.lit("")), F.lit(TOKENS), F.lit(1))


def _leading(x: Column, holds) -> Column:
    """How many elements from the first on meet a condition."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda a, e: F.when(a["on"] & holds(e), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("on")))
    return F.aggregate(x, begin, step, lambda a: a["n"])


def postfix(t: Column) -> Column:
    """Tokens with operators after what they apply to; the stack's top is its first element.

    An operator takes those before it from the stack that bind as tightly, a power only those that bind more tightly.
    """
    binds = F.create_map(*[F.lit(x) for kv in BINDS.items() for x in kv])
    none = F.array().cast("array<string>")
    begin = F.struct(none.alias("out"), none.alias("stack"), F.lit(None).cast("string").alias("before"))

    def step(a: Column, x: Column) -> Column:
        sign = (x == "-") & (a["before"].isNull() | a["before"].isin("(", *[b for b in BINDS if b != "neg"]))
        op = F.when(sign, "neg").otherwise(x)
        own = binds[op]
        higher = lambda y: (y != "(") & F.when(op == "^", F.coalesce(binds[y], F.lit(0)) > own).otherwise(F.coalesce(binds[y], F.lit(0)) >= own)
        n = F.when(op == "neg", 0).when(own.isNotNull(), _leading(a["stack"], higher)).when(op == ")", _leading(a["stack"], lambda y: y != "(")).otherwise(0)
        taken, rest = F.slice(a["stack"], 1, n), F.slice(a["stack"], n + 1, F.size(a["stack"]))
        inner = F.slice(rest, 2, F.size(rest))  # without the opening parenthesis
        called = F.coalesce(F.get(inner, F.lit(0)).isin(*CALLS), F.lit(False))
        number = op.rlike(r"^\d")
        closes = op == ")"
        out = F.when(number, F.array_append(a["out"], op)).when(closes & called, F.concat(a["out"], taken, F.slice(inner, 1, 1))).otherwise(F.concat(a["out"], taken))
        stack = F.when(number, a["stack"]).when(closes & called, F.slice(inner, 2, F.size(inner))).when(closes, inner).otherwise(F.concat(F.array(op), rest))
        return F.struct(out.alias("out"), stack.alias("stack"), x.alias("before"))

    return F.aggregate(t, begin, step, lambda a: F.concat(a["out"], a["stack"]))


def run(rpn: Column) -> Column:
    """The value of tokens in postfix order; null where one lacks its numbers, where something is left over, or a number isn't defined."""
    begin = F.struct(F.array().cast("array<double>").alias("s"), F.lit(True).alias("ok"))

    def step(a: Column, x: Column) -> Column:
        b, c = F.get(a["s"], F.lit(0)), F.get(a["s"], F.lit(1))
        one, two = x.isin("neg", *CALLS), x.isin("+", "-", "*", "/", "%", "^")
        unary = F.when(x == "neg", -b).when(x == "abs", F.abs(b)).when((x == "sqrt") & (b >= 0), F.sqrt(b))
        binary = F.when(x == "+", c + b).when(x == "-", c - b).when(x == "*", c * b).when(x == "/", F.try_divide(c, b)).when(x == "%", c - b * F.floor(F.try_divide(c, b))).when(x == "^", F.pow(c, b))
        value = F.when(one, unary).when(two, binary).otherwise(x.try_cast("double"))
        left = F.slice(a["s"], F.when(one, 2).when(two, 3).otherwise(1), F.size(a["s"]) + 1)
        return F.struct(F.concat(F.array(value), left).alias("s"), (a["ok"] & value.isNotNull() & ~F.isnan(value)).alias("ok"))

    return F.aggregate(rpn, begin, step, lambda a: F.when(a["ok"] & (F.size(a["s"]) == 1), F.get(a["s"], F.lit(0))))


def evaluate(text: Column) -> Column:
    """The value of an expression with + - * / % ^ ** ( ) sqrt abs and signs; null if it has none."""
    return run(postfix(tokens(text)))

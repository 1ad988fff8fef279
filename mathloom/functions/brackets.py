"""Groups of tokens at any depth: one pass over the tokens of a text with a stack of open places.

Both functions split at single spaces and walk the tokens once with ``aggregate``. What is written
so far is a string, so a step copies bytes and no array of tokens grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token is to the walk.
_OTHER, _ONE, _TWO, _OPTIONAL, _OPEN, _CLOSE, _LEFT, _RIGHT = range(8)
# What the walk waits for: nothing, the argument of a chain of heads, the first or second of two
# arguments, an optional argument or the only one, the only one after an optional one.
_NOTHING, _CHAIN, _FIRST, _SECOND, _EITHER, _LAST = range(6)
# What an open place is: a plain brace, the first of two arguments, an optional argument, a bracket
# inside one. An entry of the stack is four times the braces that close it, plus this.
_PLAIN, _FIRST_GROUP, _OPTION, _BRACKET = range(4)


def fill_arguments(c: Column, one: tuple[str, ...], two: tuple[str, ...], optional: tuple[str, ...]) -> Column:
    """Braces around arguments of a single token, for heads with one argument, with two, and with an
    optional one in brackets before the only one.

    A chain of one-argument heads nests: ``\\a \\b x`` is ``\\a { \\b { x } }``, and a group at its end
    of any depth is taken whole. A head that stands where one token is wanted, or before a closing
    brace, gets empty arguments. Heads at the end of a text and braces that never close stay open.
    """
    sort = F.create_map(
        *[
            x
            for names, kind in (
                (one, _ONE), (two, _TWO), (optional, _OPTIONAL),
                (("{",), _OPEN), (("}",), _CLOSE), (("[",), _LEFT), (("]",), _RIGHT),
            )
            for name in names
            for x in (F.lit(name), F.lit(kind))
        ]
    )
    start = F.struct(
        F.lit("").alias("out"),
        F.array().cast("array<int>").alias("stack"),
        F.lit(_NOTHING).alias("wants"),
        F.lit(0).alias("heads"),
    )

    def step(s: Column, token: Column) -> Column:
        kind = F.coalesce(F.element_at(sort, token), F.lit(_OTHER))
        # ``let`` keeps the kind from being looked up in every branch
        return F.element_at(F.transform(F.array(kind), lambda k: moved(s, token, k)), 1)

    def moved(s: Column, token: Column, kind: Column) -> Column:
        wants, heads, stack = s["wants"], s["heads"], s["stack"]
        top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(4 + _PLAIN))
        inside = (top % 4).isin(_OPTION, _BRACKET)
        closers = F.repeat(F.lit(" }"), heads)
        popped = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        body = F.concat(
            F.lit(" { "),
            token,
            F.when(kind == _TWO, " { } { }").when(kind.isin(_ONE, _OPTIONAL), " { }").otherwise(""),
        )
        free = wants == _NOTHING
        chained = (wants == _CHAIN) & (kind == _ONE)
        wrapped = ~free & ~kind.isin(_OPEN, _CLOSE) & ~chained & ~((wants == _EITHER) & (kind == _LEFT))
        # an argument that is missing before a closing brace
        missing = (
            F.when(wants == _CHAIN, F.concat(F.lit(" {"), closers))
            .when(wants == _FIRST, F.lit(" { } { }"))
            .when(free, F.lit(""))
            .otherwise(F.lit(" { }"))
        )
        written = (
            F.when(kind == _CLOSE, F.concat(missing, F.repeat(F.lit(" }"), F.floor(top / 4).cast("int"))))
            .when(chained, F.concat(F.lit(" { "), token))
            .when(wrapped, F.concat(body, F.when(wants == _CHAIN, closers).otherwise(F.lit(" }"))))
            .otherwise(F.concat(F.lit(" "), token))
        )
        entry = (
            F.when(kind == _OPEN, F.when(wants == _CHAIN, 4 * heads).when(wants == _FIRST, F.lit(4 + _FIRST_GROUP)).otherwise(F.lit(4 + _PLAIN)))
            .when((kind == _LEFT) & (wants == _EITHER), F.lit(4 + _OPTION))
            .when((kind == _LEFT) & free & inside, F.lit(4 + _BRACKET))
        )
        pops = (kind == _CLOSE) | ((kind == _RIGHT) & free & inside)
        after = F.when(top % 4 == _FIRST_GROUP, _SECOND).when(top % 4 == _OPTION, _LAST).otherwise(_NOTHING)
        return F.struct(
            F.concat(s["out"], written).alias("out"),
            F.when(entry.isNotNull(), F.concat(stack, F.array(entry))).when(pops, popped).otherwise(stack).alias("stack"),
            F.when(pops, after)
            .when(chained, _CHAIN)
            .when(wrapped, F.when(wants == _FIRST, _SECOND).otherwise(_NOTHING))
            .when(free & (kind == _ONE), _CHAIN)
            .when(free & (kind == _TWO), _FIRST)
            .when(free & (kind == _OPTIONAL), _EITHER)
            .otherwise(_NOTHING)
            .alias("wants"),
            F.when(chained, heads + 1).otherwise(F.lit(1)).alias("heads"),
        )

    def done(s: Column) -> Column:
        # heads at the end: those that opened a brace close it
        left = F.when(s["wants"] == _CHAIN, F.repeat(F.lit(" }"), s["heads"] - 1)).otherwise(F.lit(""))
        whole = F.concat(s["out"], left)
        return F.substring(whole, F.lit(2), F.length(whole))

    tokens = F.split(c, " ")
    heads = F.array(*map(F.lit, (*one, *two, *optional)))
    return F.when(F.arrays_overlap(tokens, heads), F.aggregate(tokens, start, step, done)).otherwise(c)


_FREE, _GROUP, _AFTER, _ROUND = range(4)


def glue_groups(c: Column, once: str, rules: tuple[str, ...]) -> Column:
    """Spaces out from a head to the end of its group: the first ``once``, and every one of ``rules``.

    The group is the first one in braces after the head, at any depth; a rule may have one in round
    brackets before it. A head whose group never ends stays as it is.
    """
    start = F.struct(
        F.lit("").alias("out"), F.lit("").alias("glued"), F.lit("").alias("plain"),
        F.lit(_FREE).alias("mode"), F.lit(0).alias("depth"), F.lit(False).alias("seen"),
    )

    def step(s: Column, token: Column) -> Column:
        mode = s["mode"]
        free = mode == _FREE
        begins = free & (token.isin(*rules) | ((token == once) & ~s["seen"]))
        round_ = ((mode == _AFTER) & (token == "(")) | (mode == _ROUND)
        change = F.when(round_, (token == "(").cast("int") - (token == ")").cast("int")).otherwise(
            (token == "{").cast("int") - (token == "}").cast("int")
        )
        depth = F.when(free, F.lit(0)).otherwise(s["depth"] + change)
        closes = ~free & (depth == 0) & F.when(round_, token == ")").otherwise(token == "}")
        ends = closes & ~round_
        spaced = F.concat(F.lit(" "), token)
        glued, plain = F.concat(s["glued"], token), F.concat(s["plain"], spaced)
        return F.struct(
            F.when(ends, F.concat(s["out"], F.lit(" "), glued)).when(free & ~begins, F.concat(s["out"], spaced)).otherwise(s["out"]).alias("out"),
            F.when(begins, token).when(free | ends, F.lit("")).otherwise(glued).alias("glued"),
            F.when(begins, spaced).when(free | ends, F.lit("")).otherwise(plain).alias("plain"),
            F.when(begins, F.when(token == once, _GROUP).otherwise(_AFTER))
            .when(free | ends, _FREE)
            .when(round_, F.when(closes, _GROUP).otherwise(_ROUND))
            .otherwise(_GROUP)
            .alias("mode"),
            depth.alias("depth"),
            (s["seen"] | (begins & (token == once))).alias("seen"),
        )

    tokens = F.split(c, " ")
    whole = F.aggregate(tokens, start, step, lambda s: F.concat(s["out"], s["plain"]))
    heads = F.array(F.lit(once), *map(F.lit, rules))
    return F.when(F.arrays_overlap(tokens, heads), F.substring(whole, F.lit(2), F.length(c))).otherwise(c)

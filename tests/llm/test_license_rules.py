import itertools
import re
from re import _constants, _parser

from tessera.llm import license_rules


def spelled(parsed):
    """Every way to write a parsed expression; of a class of characters, the first."""
    parts = []
    for op, value in parsed:
        if op is _constants.LITERAL:
            parts.append([chr(value)])
        elif op is _constants.IN:
            parts.append([chr(value[0][1] if value[0][0] is _constants.LITERAL else value[0][1][0])])
        elif op is _constants.BRANCH:
            parts.append([x for branch in value[1] for x in spelled(branch)])
        elif op is _constants.SUBPATTERN:
            parts.append(list(spelled(value[3])))
        elif op is _constants.MAX_REPEAT and value[:2] == (0, 1):
            parts.append(["", *spelled(value[2])])
        elif op is _constants.MAX_REPEAT and value[0] == value[1]:
            parts.append([x * value[0] for x in spelled(value[2])])
        else:
            raise ValueError(op)
    return ["".join(x) for x in itertools.product(*parts)]


def test_every_spelling_of_a_rule_holds_its_keywords():
    gate = re.compile(license_rules.gate())
    for _, label, _, _, keyword, needed, expression in license_rules.rules():
        inner = expression.removeprefix("(?<= )").removesuffix("(?= )")
        for text in spelled(_parser.parse(inner)):
            text = f" {text} "
            assert re.search(expression, text) and keyword in text and needed in text and gate.search(text), (label, text)

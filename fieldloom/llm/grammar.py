"""Grammars as networks of states: extended rules are compiled, per nonterminal, to a deterministic automaton over its symbols."""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

import numpy as np

#: What a terminal does to the number of open brackets.
BRACKETS = {"{": 1, "(": 1, "[": 1, "OPEN": 1, "OPEN?": 1, "}": -1, ")": -1, "]": -1, "CLOSE": -1}
_SYMBOL = re.compile(r"\s*('[^']+'|[A-Za-z]\w*|[()|?*+])")


class Grammar:
    """Tables for the chart parser. Rules: ``Name = ...;`` for nonterminals, ``name = ...;`` for parts that are inlined; 'x' is a terminal.

    states are numbered over all nonterminals; ``shifts[q]`` leads by terminal, ``calls[q]`` by nonterminal, ``rule[q]`` is the nonterminal of q.
    ``moves[q][t]`` has all that a state can do before token t: (done, ((nonterminal, its start, next state), ...), next state or None).

    ``keyed`` nonterminals take the name of the token before them, which the ``paired`` terminals in them must share. Terminals that end in ``?`` stand for
    an inserted token of any name, so that the ones without are only matched (``only_matched``).
    """

    def __init__(self, text: str, keyed: str = "", paired: str = "") -> None:
        self.keyed, self.paired = frozenset(keyed.split()), frozenset(paired.split())
        parts = {}
        for rule in text.split(";\n"):
            if rule.strip():
                name, _, body = rule.partition("=")
                parts[name.strip()] = _SYMBOL.findall(body)
        self.start, self.shifts, self.calls, self.final, self.rule = {}, [], [], [], []
        for name in parts:
            if name[0].isupper():
                self._compile(name, parts)
        self._sets()
        self.terminals = frozenset(t for own in self.shifts for t in own)
        self.only_matched = frozenset(t[:-1] for t in self.terminals if t.endswith("?") and len(t) > 1)
        self._depths()

    def _compile(self, name: str, parts: dict[str, list[str]]) -> None:
        links: list[list[tuple[str | None, int]]] = []

        def new() -> int:
            links.append([])
            return len(links) - 1

        def choice(tokens: list[str], i: int, a: int, b: int) -> int:
            while True:
                i = series(tokens, i, a, b)
                if i >= len(tokens) or tokens[i] != "|":
                    return i
                i += 1

        def series(tokens: list[str], i: int, a: int, b: int) -> int:
            while i < len(tokens) and tokens[i] not in ")|":
                x, y = new(), new()
                links[a].append((None, x))
                if tokens[i] == "(":
                    i = choice(tokens, i + 1, x, y) + 1
                elif tokens[i][0] == "'" or tokens[i][0].isupper():
                    links[x].append((tokens[i], y))
                    i += 1
                else:
                    choice(parts[tokens[i]], 0, x, y)
                    i += 1
                a = new()
                links[y].append((None, a))
                if i < len(tokens) and tokens[i] in "?*+":
                    if tokens[i] != "+":
                        links[x].append((None, a))
                    if tokens[i] != "?":
                        links[y].append((None, x))
                    i += 1
            links[a].append((None, b))
            return i

        first, last = new(), new()
        choice(parts[name], 0, first, last)

        def closure(states: frozenset[int]) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for symbol, to in links[todo.pop()]:
                    if symbol is None and to not in seen:
                        seen.add(to)
                        todo.append(to)
            return frozenset(seen)

        known: dict[frozenset[int], int] = {}

        def state(of: frozenset[int]) -> int:
            if of not in known:
                known[of] = len(self.rule)
                self.rule.append(name)
                self.shifts.append({})
                self.calls.append({})
                self.final.append(last in of)
                todo.append(of)
            return known[of]

        todo: list[frozenset[int]] = []
        self.start[name] = state(closure(frozenset([first])))
        while todo:
            of = todo.pop()
            by: dict[str, set[int]] = {}
            for s in of:
                for symbol, to in links[s]:
                    if symbol is not None:
                        by.setdefault(symbol, set()).add(to)
            for symbol in sorted(by):
                to = state(closure(frozenset(by[symbol])))
                if symbol[0] == "'":
                    self.shifts[known[of]][symbol[1:-1]] = to
                else:
                    self.calls[known[of]][symbol] = to

    def _sets(self) -> None:
        n = len(self.rule)
        begins: dict[str, set[str]] = {x: set() for x in self.start}
        follow: dict[str, set[str]] = {x: set() for x in self.start}
        begin = lambda q: set(self.shifts[q]).union(*[begins[c] for c in self.calls[q]])
        changed = True
        while changed:
            before = sum(map(len, begins.values())) + sum(map(len, follow.values()))
            for x, q in self.start.items():
                begins[x] |= begin(q)
            for q in range(n):
                for c, to in self.calls[q].items():
                    follow[c] |= begin(to)
                    if self.final[to]:
                        follow[c] |= follow[self.rule[q]]
            changed = before != sum(map(len, begins.values())) + sum(map(len, follow.values()))
        self.moves: list[dict] = []
        for q in range(n):
            ahead = begin(q) | (follow[self.rule[q]] if self.final[q] else set())
            self.moves.append(
                {
                    t: (
                        self.final[q] and t in follow[self.rule[q]],
                        tuple((c, self.start[c], to) for c, to in self.calls[q].items() if t in begins[c]),
                        self.shifts[q].get(t),
                    )
                    for t in ahead
                }
            )
        #: least number of tokens from a state to the end of its nonterminal, and of a whole nonterminal
        far = 10**9
        self.rest, self.least = [0 if self.final[q] else far for q in range(n)], dict.fromkeys(self.start, far)
        changed = True
        while changed:
            changed = False
            for q in range(n):
                best = min([self.rest[q], *[1 + self.rest[to] for to in self.shifts[q].values()], *[self.least[c] + self.rest[to] for c, to in self.calls[q].items()]])
                if best < self.rest[q]:
                    self.rest[q], changed = best, True
            for x, q in self.start.items():
                if self.rest[q] < self.least[x]:
                    self.least[x], changed = self.rest[q], True

    def _depths(self) -> None:
        """``off``: brackets opened from a nonterminal's begin to a state; where that isn't the same on all ways, none are counted."""
        for brackets in (BRACKETS, {}):
            off: list[int | None] = [None] * len(self.rule)
            net: dict[str, int] = {}
            for q in self.start.values():
                off[q] = 0
            fits = changed = True
            while changed and fits:
                changed = False
                for q, at in enumerate(off):
                    if at is None:
                        continue
                    if self.final[q]:
                        changed |= self.rule[q] not in net
                        fits &= net.setdefault(self.rule[q], at) == at
                    for to, then in [*[(to, at + brackets.get(t, 0)) for t, to in self.shifts[q].items()], *[(to, at + net[c]) for c, to in self.calls[q].items() if c in net]]:
                        changed |= off[to] is None
                        off[to] = then if off[to] is None else off[to]
                        fits &= off[to] == then
            if fits:
                break
        self.off, self.brackets = [x or 0 for x in off], brackets

    @cached_property
    def loose(self) -> Loose:
        """The network in which a nonterminal may return to any place it is called from."""
        return Loose(self)


class Loose:
    """A grammar's network without the memory of where a nonterminal was called, its states merged where they have the same future.

    ``cls``: class of each state, of ``n``; edges by class, terminals left out: ``first`` of each class, ``to``, ``step`` (of brackets; 2 for one that
    closes above the cap); ``by_token``: the edges of a terminal as classes, first of each, to, step; ``ends``: classes before the end of the text.
    """

    def __init__(self, g: Grammar) -> None:
        count = len(g.rule)
        after: dict[str, set[int]] = {}
        for q in range(count):
            for c, to in g.calls[q].items():
                after.setdefault(c, set()).add(to)
        free = [{g.start[c] for c in g.calls[q]} | (after.get(g.rule[q], set()) if g.final[q] else set()) for q in range(count)]
        future: list[frozenset] = []
        known: dict[frozenset, frozenset] = {}
        for q in range(count):
            seen, todo = {q}, [q]
            while todo:
                new = free[todo.pop()] - seen
                seen |= new
                todo.extend(new)
            key = frozenset(x for x in seen if g.shifts[x])
            if key not in known:
                known[key] = frozenset((t, to) for x in key for t, to in g.shifts[x].items())
            future.append(known[key])
        same: dict = {}
        cls = [same.setdefault(frozenset(t for t, _ in f), len(same)) for f in future]
        while True:
            before, same, done = len(same), {}, {}
            cls_of = []
            for q in range(count):
                f = future[q]
                if f not in done:
                    done[f] = frozenset((t, cls[to]) for t, to in f)
                cls_of.append(same.setdefault((cls[q], done[f]), len(same)))
            cls = cls_of
            if len(same) == before:
                break
        self.cls, self.n = cls, len(same)
        edges: dict[tuple, None] = {}
        for q in range(count):
            for t, to in sorted(future[q]):
                edges[cls[q], t, cls[to]] = None
        self.ends = np.array(sorted({k for k, t, _ in edges if t == "$"}))
        steps = lambda t: [g.brackets.get(t, 0), 2] if g.brackets.get(t, 0) < 0 else [g.brackets.get(t, 0)]

        def sorted_edges(found: set[tuple[int, int, int]]) -> tuple:
            rows = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
            which, first = np.unique(rows[:, 0], return_index=True)
            return which, first, rows[:, 1], rows[:, 2]

        every = {(k, to, s) for k, t, to in edges if t != "$" and t not in g.only_matched for s in steps(t)}
        every |= {(k, 0, -FAR_DOWN) for k in range(self.n)}  # leads nowhere, so that each class has one
        _, self.first, self.to, self.step = sorted_edges(every)
        by: dict[str, set[tuple[int, int, int]]] = {}
        for k, t, to in edges:
            if t != "$":
                by.setdefault(t, set()).update((k, to, s) for s in steps(t))
        self.by_token = {t: sorted_edges(found) for t, found in by.items()}


FAR_DOWN = 1000

JSON = """
Start = Value '$';
Value = '{' ( member ( ',' member )* )? '}' | '[' ( Value ( ',' Value )* )? ']' | 'string' | 'scalar';
member = 'string' ':' Value;
"""

JAVA = """
Start = ( Annotation* 'package' qname ';' )? ( import | ';' )* ( TypeDecl | ';' )* '$' | import* Annotation* 'open'? 'module' qname '{' directive* '}' '$';
import = 'import' 'static'? qname ( '.' '*' )? ';';
directive = 'requires' ( 'transitive' | 'static' )* qname ';' | ( 'exports' | 'opens' ) qname ( 'to' qname ( ',' qname )* )? ';' | 'uses' qname ';' | 'provides' qname 'with' qname ( ',' qname )* ';';
id = 'ID' | 'record' | 'sealed' | 'permits' | 'yield' | 'open' | 'module' | 'requires' | 'transitive' | 'exports' | 'opens' | 'to' | 'uses' | 'provides' | 'with';
qname = id ( '.' id )*;
prim = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double';
gt = '>' | '>+';
Annotation = '@' qname ( '(' ( id '=' ElementValue ( ',' id '=' ElementValue )* | ElementValue )? ')' )?;
ElementValue = Expr | Annotation | '{' ( ElementValue ( ',' ElementValue )* )? ','? '}';
modifier = Annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed';
TypeDecl = modifier* TypeRest;
types = Type ( ',' Type )*;
TypeRest = 'class' id TypeParams? ( 'extends' Type )? ( 'implements' types )? ( 'permits' types )? ClassBody | 'interface' id TypeParams? ( 'extends' types )? ( 'permits' types )? ClassBody | 'enum' id ( 'implements' types )? EnumBody | 'record' id TypeParams? params ( 'implements' types )? ClassBody | '@' 'interface' id ClassBody;
TypeParams = '<' typeparam ( ',' typeparam )* gt;
typeparam = Annotation* id ( 'extends' Type ( '&' Type )* )?;
dims = ( Annotation* '[' ']' )*;
typeargs = TypeArgs;
classtype = id TypeArgs? ( '.' Annotation* id TypeArgs? )*;
Type = Annotation* ( prim | classtype ) dims;
TypeArgs = '<' typearg ( ',' typearg )* gt;
typearg = Type | Annotation* '?' ( ( 'extends' | 'super' ) Type )?;
ClassBody = '{' ( Member | ';' )* '}';
param = ( Annotation | 'final' )* Type ( Annotation* '...' )? ( id dims | ( id '.' )? 'this' );
params = '(' ( param ( ',' param )* )? ')';
throws = ( 'throws' types )?;
Member = 'static'? Block | modifier* ( TypeRest | TypeParams? id params throws Block | id Block | TypeParams? ( Type | 'void' ) id params dims throws ( 'default' ElementValue )? ( Block | ';' ) | Type declarators ';' );
declarator = id dims ( '=' VarInit )?;
declarators = declarator ( ',' declarator )*;
VarInit = Expr | ArrayInit;
ArrayInit = '{' ( VarInit ( ',' VarInit )* )? ','? '}';
EnumBody = '{' ( enumconstant ( ',' enumconstant )* )? ','? ( ';' ( Member | ';' )* )? '}';
enumconstant = Annotation* id Args? ClassBody?;
Args = '(' ( Expr ( ',' Expr )* )? ')';
Block = '{' BlockStmt* '}';
BlockStmt = stmt | classtype dims declarators ';' | prim dims declarators ';' | ( Annotation | 'final' )+ Type declarators ';' | modifier* TypeRest;
Stmt = stmt;
condition = '(' Expr ')';
catch = 'catch' '(' ( Annotation | 'final' )* Type ( '|' Type )* id ')' Block;
finally = 'finally' Block;
resource = ( Annotation | 'final' )* Type id '=' Expr | Expr;
stmt = Block | ';' | 'if' condition Stmt ( 'else' Stmt )? | 'while' condition Stmt | 'do' Stmt 'while' condition ';' | 'for' '(' forhead ')' Stmt | 'switch' condition SwitchBody | 'try' ( Block ( catch+ finally? | finally ) | '(' resource ( ';' resource )* ';'? ')' Block catch* finally? ) | 'return' Expr? ';' | ( 'break' | 'continue' ) id? ';' | 'throw' Expr ';' | 'synchronized' condition Block | 'assert' Expr ( ':' Expr )? ';' | 'yield' Expr ';' | id ':' Stmt | stmtexpr ';';
StmtExpr = stmtexpr;
forhead = ( StmtExpr ( ',' StmtExpr )* | ( Annotation | 'final' )* Type declarators )? ';' Expr? ';' ( StmtExpr ( ',' StmtExpr )* )? | ( Annotation | 'final' )* Type id ':' Expr;
label = 'case' Expr ( ',' Expr )* | 'default';
SwitchBody = '{' ( ( label '->' ( Expr ';' | Block | 'throw' Expr ';' ) )* | ( ( label ':' )+ BlockStmt* )* ) '}';
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>+' '>=' | '>+' '>+' '>=';
binary = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>+' '>' | '>+' '>+' '>';
Expr = ( Unary | Lambda ) ( binary Unary | assign ( Unary | Lambda ) | 'instanceof' ( Annotation | 'final' )* Type id? | '?' Expr ':' ( Unary | Lambda ) )*;
Lambda = ( id | '(' ( id ( ',' id )* | lambdaparam ( ',' lambdaparam )* )? ')' ) '->' ( Expr | Block );
lambdaparam = ( Annotation | 'final' )* Type '...'? id dims;
primcast = '(' prim ')';
cast = '(' Annotation* ( prim ( Annotation* '[' ']' )+ | classtype dims ) ( '&' Type )* ')';
Unary = ( '+' | '-' | '++' | '--' | '!' | '~' | primcast )* ( value | cast CastOperand );
CastOperand = ( '!' | '~' | primcast ) Unary | value | cast CastOperand | Lambda;
value = ( callhead | plainhead | 'switch' condition SwitchBody ) ( callpart | plainpart )* ( '++' | '--' )*;
callhead = id Args | 'this' Args | 'super' Args | 'super' '.' TypeArgs? id Args | Creator;
plainhead = 'LIT' | '(' Expr ')' | 'this' | 'super' ( '.' | '::' ) id | id | prim dims ( '.' 'class' | '::' 'new' ) | 'void' '.' 'class';
callpart = '.' TypeArgs? id Args | '.' Creator | '.' 'super' ( Args | '.' TypeArgs? id Args );
plainpart = '.' ( id | 'this' | 'class' ) | '.' 'super' ( '.' | '::' ) id | '[' Expr ']' | '::' TypeArgs? ( id | 'new' ) | ( '[' ']' )+ ( '.' 'class' | '::' 'new' ) | TypeArgs ( '.' id TypeArgs? )* dims '::' ( id | 'new' );
stmtexpr = ( '++' | '--' ) Unary | ( callhead | plainhead ) ( callpart | plainpart )* ( '++' | '--' | assign Expr ) | callhead | ( callhead | plainhead ) ( callpart | plainpart )* callpart;
Creator = 'new' TypeArgs? Annotation* ( createdtype | prim ) ( Args ClassBody? | ( Annotation* '[' Expr ']' )+ dims | ( Annotation* '[' ']' )+ ArrayInit );
createdtype = id ( TypeArgs | '<' gt )? ( '.' Annotation* id ( TypeArgs | '<' gt )? )*;
"""


XML = """
Start = 'DECL'? 'DOCTYPE'? Element '$';
content = Element | 'TEXT' | 'CDATA';
Element = 'EMPTY' | 'OPEN' Inside | 'OPEN?' Loose;
Inside = content* 'CLOSE';
Loose = content* 'CLOSE';
"""


@lru_cache(maxsize=8)
def grammar(language: str) -> Grammar:
    """The compiled grammar of ``java``, ``json`` or ``xsd``, once per process."""
    if language == "xsd":
        return Grammar(XML, keyed="Inside", paired="CLOSE")
    return Grammar(JAVA if language == "java" else JSON)

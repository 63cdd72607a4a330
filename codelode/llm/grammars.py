"""Lexers and generalised LL grammars of the languages of a source collection.

Grammars describe what a chunk may hold: whole files, or any run of top-level or member
definitions. They are syntactic only, and accept a superset where the languages leave checks to
later phases. ``'('!`` marks the parenthesis after a function's name.
"""

from __future__ import annotations

import re
from functools import lru_cache

from codelode.llm.gll import EOF, ERROR, Grammar

SKIP, NEWLINE = -1, -2

_ID = r"[^\W\d][\w$]*"
_NUM = r"0[xXbBoO][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?\w*|\.\d[\d_]*(?:[eE][+-]?\d+)?\w*"
_DQ, _SQ = r'"(?:[^"\\\n]|\\.|\\\n)*"', r"'(?:[^'\\\n]|\\.|\\\n)*'"
_CBLOCK, _CLINE = r"/\*(?s:.*?)\*/", r"//[^\n]*"


class Kinds(dict):
    """Terminal of a lexeme; a cache that starts over when it grows too large."""

    def __init__(self, terminals: dict[str, int], classify, rejects=None):
        super().__init__()
        self._t, self._classify, self._rejects = terminals, classify, rejects

    def __missing__(self, lexeme: str) -> int:
        if len(self) > 300_000:
            self.clear()
        k = self._t.get(lexeme)
        if k is None or lexeme in ("NAME", "NUM", "STR"):
            k = self._classify(lexeme)
            k = k if isinstance(k, int) else self._t.get(k, ERROR)
        if self._rejects and self._rejects(lexeme):
            k = ERROR
        self[lexeme] = k
        return k


class Language:
    """A lexer and the grammars of the dialects of one language."""

    def __init__(self, pattern: str, classify, grammars: list[str], flags: int = 0, layout=None, fold: bool = False, rejects=None):
        self.rx = re.compile(pattern, re.M | flags)
        made = {g: Grammar(g) for g in dict.fromkeys(grammars)}
        self.dialects = [made[g] for g in grammars]
        self.kinds = [Kinds(g.terminals, classify, no) for g, no in zip(self.dialects, rejects or [None] * len(grammars), strict=True)]
        self.layout, self.fold = layout, fold

    def lexemes(self, text: str) -> list[str]:
        if self.rx.groups:
            return [m[0] for m in self.rx.finditer(text)]
        return self.rx.findall(text)

    def tokens(self, lexemes: list[str], dialect: int = 0) -> tuple[list[int], list[int] | None]:
        """Terminals with ``EOF`` at the end; and for each the index of its lexeme (None: see ``where``)."""
        kinds = self.kinds[dialect]
        if self.fold:
            lexemes = [x.lower() if x[0].isalpha() else x for x in lexemes]
        if self.layout:
            return self.layout(lexemes, kinds, self.dialects[dialect].terminals)
        out = [k for k in map(kinds.__getitem__, lexemes) if k >= 0]
        out.append(EOF)
        return out, None

    def where(self, lexemes: list[str], dialect: int = 0) -> list[int]:
        """Lexeme index of each token of a language without layout."""
        kinds = self.kinds[dialect]
        return [j for j, k in enumerate(map(kinds.__getitem__, lexemes)) if k >= 0]

    def accepting(self, text: str) -> int | None:
        """Number of the first dialect that accepts the text, None if there is none; a text without tokens is valid."""
        lexemes = self.lexemes(text)
        for d, g in enumerate(self.dialects):
            toks, _ = self.tokens(lexemes, d)
            if len(toks) == 1 or ERROR not in toks and g.parse(toks)[0]:
                return d
        return None

    def accepts(self, text: str) -> bool:
        """True if any dialect accepts the text."""
        return self.accepting(text) is not None


def _c_like(lexeme: str):
    c = lexeme[0]
    if c == "/" and lexeme[1:2] in ("/", "*"):
        return SKIP if len(lexeme) > 2 or lexeme == "//" else ERROR
    if c.isalpha() or c == "_" or c == "$":
        return "NAME"
    if c.isdigit() or (c == "." and lexeme[1:2].isdigit()):
        return "NUM"
    if c in "\"'`" and len(lexeme) > 1:
        return "STR"
    if c == "#":
        return SKIP if len(lexeme) > 1 else ERROR
    if c == "\n":
        return NEWLINE
    return ERROR


def _fill(text: str, slots: dict[str, str]) -> str:
    return re.sub(r"%(\w+)%", lambda m: slots[m[1]], text)


# ---------------------------------------------------------------- Java

JAVA = r"""
file := item+
rest := (item | stmt | '}')+
item := 'package' qname ';' | 'import' 'static'? qname ';' | member
qname := id ('.' (id | '*'))*
id := NAME | 'record' | 'sealed' | 'permits' | 'var' | 'yield' | 'module' | 'with' | 'when'
mod := annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
annotation := '@' id ('.' id)* ('(' (annarg (',' annarg)*)? ')')?
annarg := annvalue ('=' annvalue)?
annvalue := expr | annotation | '{' (annvalue (',' annvalue)*)? ','? '}'
member! := ';' | mod+ (declared | block) | declared | block
declared := classdecl | typeparams? typed
classdecl := ('class' | 'interface' | '@' 'interface') id typeparams? ('extends' type (',' type)*)? ('implements' type (',' type)*)? ('permits' type (',' type)*)? body
  | 'enum' id ('implements' type (',' type)*)? '{' (econst (',' econst)*)? ','? (';' member*)? '}'
  | 'record' id typeparams? '(' params? ')' ('implements' type (',' type)*)? body
econst := annotation* id ('(' args? ')')? body?
body := '{' member* '}'
typeparams := '<' tparam (',' tparam)* '>'
tparam := annotation* id ('extends' type ('&' type)*)?
typed := type ( id ( '('! params? ')' dims? ('throws' type (',' type)*)? (block | ';' | 'default' annvalue ';') | dims? ('=' init)? (',' vardecl)* ';' ) | '('! params? ')' ('throws' type (',' type)*)? block )
dims := ('[' ']')+
vardecl := id dims? ('=' init)?
init := expr | '{' (init (',' init)*)? ','? '}'
params := param (',' param)*
param := ('final' | annotation)* type '...'? (id ('.' 'this')? | 'this') dims?
type := (prim | id targs? ('.' annotation* id targs?)*) dims?
prim := 'int' | 'long' | 'short' | 'byte' | 'char' | 'float' | 'double' | 'boolean' | 'void'
targs := '<' (targ (',' targ)*)? '>'
targ := annotation* ('?' (('extends' | 'super') type ('&' type)*)? | type)
block := '{' stmt* '}'
stmt := block | ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' forhead ')' stmt | 'return' expr? ';' | 'throw' expr ';' | 'break' id? ';' | 'continue' id? ';' | 'assert' expr (':' expr)? ';'
  | 'try' ('(' resource (';' resource)* ';'? ')')? block catch* ('finally' block)? | 'switch' '(' expr ')' switchbody | 'synchronized' '(' expr ')' block
  | 'yield' expr ';' | local ';' | expr (';' | ':' stmt) | ('final' | 'abstract' | 'static' | annotation)+ (classdecl | type vardecl (',' vardecl)* ';') | classdecl
catch := 'catch' '(' ('final' | annotation)* type ('|' type)* id ')' block
resource := ('final' | annotation)* type id '=' expr | expr
local := type vardecl (',' vardecl)*
forhead := (fordecl | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? | ('final' | annotation)* type id ':' expr
fordecl := ('final' | annotation)* local
switchbody := '{' group* '}'
group := label+ stmt* | arrowcase
label := ('case' pattern (',' pattern)* | 'default') ':'
arrowcase := ('case' pattern (',' pattern)* | 'default') '->' (expr ';' | block | 'throw' expr ';')
pattern := expr | 'default' | 'final'? type id ('when' expr)? | recpat ('when' expr)?
recpat := type '(' (subpat (',' subpat)*)? ')' id?
subpat := type id | recpat
expr := unary ('->' (block | expr) | assign expr | (binop operand)+ tern? | 'instanceof' 'final'? type id? (binop operand)* tern? | tern)?
operand := unary ('instanceof' 'final'? type id?)?
tern := '?' expr ':' expr
assign := '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
binop := '+' | '-' | '*' | '/' | '%' | '&&' | '||' | '&' | '|' | '^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>'
unary := ('+' | '-' | '!' | '~' | '++' | '--')* postfix
postfix := primary trailer* ('++' | '--')?
trailer := '.' (targs? (id | 'new' | 'class' | 'this' | 'super')) | '(' args? ')' | '[' expr? ']' | '::' (id | 'new')
primary := NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | id | prim dims? | paren | 'new' creator | 'switch' '(' expr ')' switchbody
args := expr (',' expr)*
paren := '(' (pitem (',' pitem)*)? ')' ('->' (block | expr) | castee)?
pitem := ('final' | annotation)* (expr | type '...'? id | castype)
castype := type ('&' type)*
castee := ('!' | '~')* castprimary trailer*
castprimary := NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | id | paren | 'new' creator
creator := annotation* (prim | id targs? ('.' id targs?)*) ( '(' args? ')' body? | ('[' expr? ']')+ arrayinit? )
arrayinit := '{' (init (',' init)*)? ','? '}'
"""

# ---------------------------------------------------------------- C

_C = r"""
file := item+
rest := (item | stmt | '}')+
item! := ';' | decl | 'asm' '(' STR ')' ';' | '_Static_assert' '(' args ')' ';' | 'extern' STR '{' item* '}'
spec := 'typedef' | 'extern' | 'static' | 'inline' | 'register' | 'auto' | 'const' | 'volatile' | 'restrict' | 'unsigned' | 'signed' | 'int' | 'char' | 'short' | 'long' | 'float' | 'double' | 'void' | '_Bool' | '_Thread_local' | '_Noreturn' | '__inline' | '__extension__' | attr | aggregate
attr := ('__attribute__' | '_Alignas' | '__declspec') '(' soup* ')'
soup := NAME | NUM | STR | ',' | '=' | '(' soup* ')' | 'const' | 'int'
aggregate := ('struct' | 'union') attr* (NAME ('{' field* '}')? | '{' field* '}') | 'enum' (NAME ('{' enums '}')? | '{' enums '}')
field := ';' | specs (fdecl (',' fdecl)*)? attr* ';'
fdecl := declarator? ':' expr | declarator
enums := enumc (',' enumc)* ','?
enumc := NAME ('=' expr)?
specs := spec+ (NAME spec*)? | NAME spec*
decl := specs declared | ('typedef' | 'static' | 'extern' | 'const')* aggregate | NAME
declared := ';' | inits ';' | declarator attr* (block %KR%)
inits := init1 (',' init1)*
init1 := declarator attr* ('=' init)?
init := assignx | braces
braces := '{' (binit (',' binit)*)? ','? '}'
binit := (desig+ '=')? init
desig := '.' NAME | '[' expr ('...' expr)? ']'
declarator := ('*' qual*)* direct
qual := 'const' | 'volatile' | 'restrict'
direct := (NAME | '(' attr* declarator ')') dtail*
dtail := '[' ('static' | qual)* expr? ']' | '('! params? ')'
params := param (',' param)* (',' '...')? | NAME (',' NAME)*
param := specs (declarator | absdecl)?
absdecl := ('*' qual*)+ absdir? | absdir
absdir := ('(' (absdecl | params)? ')' | '[' expr? ']')+
typename := specs absdecl?
block := '{' stmt* '}'
stmt := block | ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (ldecl | expr? ';') expr? ';' expr? ')' stmt
  | 'switch' '(' expr ')' stmt | 'case' cond ('...' cond)? ':' | 'default' ':' | NAME ':' | 'return' expr? ';' | 'break' ';' | 'continue' ';' | 'goto' '*'? expr ';'
  | ('asm' | '__asm__') 'volatile'? '(' soup* ')' ';' | ldecl | expr ';'
ldecl := specs (inits)? ';'
expr := assignx (',' assignx)*
assignx := unary (assign assignx | (binop unary)+ tern? | tern)?
cond := unary (binop unary)* tern?
tern := '?' expr? ':' assignx
assign := '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='
binop := '+' | '-' | '*' | '/' | '%' | '&&' | '||' | '&' | '|' | '^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>'
unary := ('+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--')* postfix
postfix := primary trailer* | 'sizeof' (unary | '(' typename ')') | '_Alignof' '(' typename ')' | '(' typename ')' (unary | braces)
trailer := '(' args? ')' | '[' expr ']' | '.' NAME | '->' NAME | '++' | '--'
args := arg (',' arg)*
arg := assignx | spec+ NAME? absdecl?
primary := NAME | NUM | STR+ | '(' expr ')' | '_Generic' '(' args ')' %GNU%
"""
#: GNU C with its extensions and the parameter declarations of old C; and ISO C, where newer words
#: (``bool``, attributes in double brackets, ``constexpr``) belong to the language and old ones don't.
C = _fill(_C, {"KR": "| (specs inits ';')+ block", "GNU": "| '(' block ')'"})
C_ISO = (
    _fill(_C, {"KR": "", "GNU": "| 'true' | 'false' | 'nullptr'"})
    .replace("attr := (", "attr := '[' '[' soup* ']' ']' | (")
    .replace("spec := 'typedef' |", "spec := 'typedef' | 'bool' | 'constexpr' | 'thread_local' | 'typeof' '(' args ')' | 'alignas' '(' args ')' |")
    .replace("| 'asm' '(' STR ')' ';' | '_Static_assert' '(' args ')' ';'", "| ('_Static_assert' | 'static_assert') '(' args ')' ';'")
    .replace("params := param (',' param)* (',' '...')? | NAME (',' NAME)*", "params := param (',' param)* (',' '...')?")
    .replace("stmt := block |", "stmt := attr stmt | block |")
    .replace("cond ('...' cond)? ':'", "cond ':'")
    .replace("'goto' '*'? expr ';'\n  | ('asm' | '__asm__') 'volatile'? '(' soup* ')' ';' | ldecl", "'goto' NAME ';' | ldecl")
    .replace("soup := NAME |", "soup := NAME | ':' | '.' |")
)

# ---------------------------------------------------------------- JavaScript and TypeScript

_JS = r"""
file := (stmt | sexpr (end | ':') | simple end)+
rest := (stmt | sexpr (end | ':') | simple end | cmember | '}')+
id := NAME | 'of' | 'get' | 'set' | 'async' | 'from' | 'as' | 'static' | 'type' | 'readonly' | 'declare' | 'abstract' | 'namespace' | 'module' | 'keyof' | 'is' | 'public' | 'private' | 'protected' | 'override' | 'satisfies' | 'infer' | 'accessor' | 'global' | 'asserts' | 'unique' | 'any' | 'unknown' | 'never' | 'string' | 'number' | 'boolean' | 'object' | 'symbol' | 'bigint' | 'undefined' | 'target' | 'meta' | 'interface'
anyname := id | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'switch' | 'case' | 'default' | 'throw' | 'try' | 'catch' | 'finally' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'instanceof' | 'this' | 'super' | 'class' | 'extends' | 'function' | 'var' | 'const' | 'import' | 'export' | 'null' | 'true' | 'false' | 'enum' | 'debugger' | 'with' | 'implements' | 'let' | 'yield' | 'await'
end := ';' | ASI
block := '{' stmts? '}'
stmts := (stmt | sexpr (end | ':') | simple end)+ (sexpr | simple)? | sexpr | simple
simple := 'return' expr? | 'throw' expr | 'break' id? | 'continue' id? | 'debugger' | ('var' | 'let' | 'const') vars
sub := stmt | (sexpr | simple) end?
stmt := block | end | func | class | 'if' '(' expr ')' sub ('else' sub)? | 'while' '(' expr ')' sub | 'do' sub 'while' '(' expr ')' end?
  | 'for' 'await'? '(' forhead ')' sub | 'switch' '(' expr ')' '{' case* '}'
  | 'try' block (ASI? 'catch' ('(' pattern %COLON% ')')? block)? (ASI? 'finally' block)? | import | export | decorated %TSSTMT%
decorated := decorator+ ASI* ('export' 'default'?)? class
vars := var1 (',' var1)*
var1! := pattern %BANG% %COLON% ('=' assign)?
pattern := id | arrpat | objpat
arrpat := '[' (pelem? ',')* pelem? ']'
pelem := '...' pattern | pattern ('=' assign)?
objpat := '{' (oprop (',' oprop)*)? ','? '}'
oprop := '...' pattern | (id ('=' assign)? | propname ':' pattern ('=' assign)?)
case := ('case' expr | 'default') ':' stmts?
forhead := (('var' | 'let' | 'const') forvars | expr)? ';' expr? ';' expr? | ('var' | 'let' | 'const') pattern ('of' assign | 'in' expr) | unary ('of' assign | 'in' expr)
forvars := forvar (',' forvar)*
forvar := pattern %COLON% ('=' assign)?
func! := 'async'? 'function' '*'? id? sig block %OVERLOAD%
sig := %TPARAMS% '('! params? ')' %RET%
params := param (',' param)* ','?
param := decorator* %PMOD% ('...')? (pattern %OPT% | 'this') %COLON% ('=' assign)?
class := %ABSTRACT% 'class' id? %TPARAMS% ('extends' unary %TARGS%)? %IMPL% '{' cmember* '}'
cmember! := end | decorator* ASI* cmod* ( '*'? propname %OPTB% ( sig (block | %NOBODY%) | %COLON% ('=' assign)? end? ) | 'static' block ) | %INDEX%
cmod := 'static' | 'async' | 'get' | 'set' | 'accessor' %CMOD%
propname := anyname | STR | NUM | '[' assign ']' | PRIVATE
decorator := '@' postfix
import := 'import' (STR | importclause 'from' STR | '(' assign ')' trailer* tailx? | '.' id trailer* tailx?) (('with' | 'assert') object)? end?
importclause := 'type'? (id (',' (named | star))? | named | star)
star := '*' 'as' id
named := '{' (spec (',' spec)*)? ','? '}'
spec := 'type'? (anyname | STR) ('as' (anyname | STR))?
export := 'export' ( 'default' (func | class | assign end ) | 'type'? named ('from' STR)? end? | 'type'? '*' ('as' anyname)? 'from' STR end? | ('var' | 'let' | 'const') vars end | func | class %TSEXPORT% )
expr := assign (',' assign)*
assign := arrow | 'yield' ('*'? assign)? | unary ('=>' (block | assign) | tailx)?
sexpr := sassign (',' assign)*
sassign := sarrow | 'yield' ('*'? assign)? | (unop+ postfix | sprimary trailer* ('++' | '--')?) ('=>' (block | assign) | tailx)?
sarrow := 'async'? %TPARAMS% '(' params? ')' %RET% '=>' (block | assign)
sprimary := NUM | STR | REGEX | 'true' | 'false' | 'null' | 'this' | 'super' | id | PRIVATE | '(' expr ')' | array | 'new' ('.' id | newx)
tailx := assop assign | (binop unary | %ASX%)+ tern? | tern
tern := '?' assign ':' assign
arrow! := 'async' id '=>' (block | assign) | 'async'? %TPARAMS% '(' params? ')' %RET% '=>' (block | assign)
assop := '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
binop := '+' | '-' | '*' | '/' | '%' | '**' | '&&' | '||' | '??' | '&' | '|' | '^' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof'
unop := '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await'
unary := unop* postfix
postfix := primary trailer* ('++' | '--')?
trailer := '.' (anyname | PRIVATE) | '?.' (anyname | PRIVATE | '[' expr ']' | '(' args? ')') | '[' expr ']' | '(' args? ')' | STR %NONNULL%
args := arg (',' arg)* ','?
arg := '...'? assign
primary := NUM | STR | REGEX | 'true' | 'false' | 'null' | 'this' | 'super' | id | PRIVATE | '(' expr ')' | array | object | func | class | 'new' ('.' id | newx) | 'import' ('(' assign ')' | '.' id)
newx := ('new')* primary newtrail* %TARGS% ('(' args? ')')?
newtrail := '.' (anyname | PRIVATE) | '[' expr ']'
array := '[' (arg? ',')* arg? ']'
object := '{' (prop (',' prop)*)? ','? '}'
prop! := '...' assign | anyname (':' assign | '=' assign | sig block)? | (STR | NUM | PRIVATE | '[' assign ']') (':' assign | sig block) | (pmod+ '*'? | '*') propname sig block
pmod := 'async' | 'get' | 'set'
"""

_TS_EXTRA = r"""
type := ('asserts'? (id | 'this') 'is')? tunion ('extends' tunion '?' type ':' type)?
tunion := '|'? tinter ('|' tinter)*
tinter := '&'? tpost ('&' tpost)*
tpost := ('keyof' | 'readonly' | 'unique' | 'infer')* tprim ('[' type? ']')*
tprim := id ('.' id)* targs? | 'void' | 'null' | 'this' | 'true' | 'false' | STR | '-'? NUM | tobj | tuple | '(' type ')' | fntype | 'typeof' (id | 'import') ('.' anyname)* targs? | 'import' '(' STR ')' ('.' id)* targs?
fntype := 'abstract'? 'new'? tparams? '(' params? ')' '=>' type
tuple := '[' (telem (',' telem)*)? ','? ']'
telem := '...'? (id '?'? ':')? type '?'?
targs := '<' type (',' type)* '>'
tparams := '<' tparam (',' tparam)* ','? '>'
tparam := ('const' | 'in' | 'out')? id ('extends' type)? ('=' type)?
tobj := '{' tmember* '}'
tmember! := end | ',' | ('readonly' | '+' 'readonly' | '-' 'readonly')? ( propname '?'? (tsig | ':' type)? | tsig | 'new' tsig | '[' id ('in' | ':') type ('as' type)? ']' (('+' | '-')? '?')? ':' type ) | ('get' | 'set') propname tsig
tsig := tparams? '('! params? ')' (':' type)?
interface := 'interface' id tparams? ('extends' type (',' type)*)? tobj
alias := 'type' id tparams? '=' type end?
enum := 'const'? 'enum' id '{' (econst (',' econst)*)? ','? '}'
econst := propname ('=' assign)?
namespace := ('namespace' | 'module' | 'global') (id ('.' id)* | STR)? block
declare := 'declare' (('var' | 'let' | 'const') vars end | func | class | interface | alias | enum | namespace)
"""

_PLAIN = {"COLON": "", "BANG": "", "TPARAMS": "", "RET": "", "PMOD": "", "OPT": "", "OPTB": "", "ABSTRACT": "", "TARGS": "", "IMPL": "", "NOBODY": "end", "INDEX": "PRIVATE", "CMOD": "", "NONNULL": "", "ASX": "PRIVATE 'in' unary", "TSSTMT": "", "TSEXPORT": "", "OVERLOAD": ""}
_TYPED = {
    "COLON": "(':' type)?",
    "BANG": "'!'?",
    "TPARAMS": "tparams?",
    "RET": "(':' type)?",
    "PMOD": "('public' | 'private' | 'protected' | 'readonly' | 'override')*",
    "OPT": "'?'?",
    "OPTB": "('?' | '!')?",
    "ABSTRACT": "'abstract'?",
    "TARGS": "targs?",
    "IMPL": "('implements' type (',' type)*)?",
    "NOBODY": "end",
    "INDEX": "cmod* '[' id ':' type ']' ':' type end?",
    "CMOD": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'",
    "NONNULL": "| '!' | targs '(' args? ')'",
    "ASX": "('as' | 'satisfies') ('const' | type)",
    "TSSTMT": "| interface | alias | enum | namespace | declare",
    "TSEXPORT": "| interface | alias | enum | namespace | declare | '=' expr end | 'as' 'namespace' id end?",
    "OVERLOAD": "| 'async'? 'function' id sig end",
}


#: A module may import, export and await anywhere; a script has ``with`` and, outside strict code,
#: names that are words of the language in a module.
JAVASCRIPT = _fill(_JS.replace(" (block | %NOBODY%)", " block"), _PLAIN).replace("| %INDEX%", "")
JS_SCRIPT = (
    JAVASCRIPT.replace(" | import | export | decorated ", " | 'with' '(' expr ')' sub | decorated ")
    .replace("id := NAME |", "id := NAME | 'await' | 'yield' | 'let' |")
    .replace("'let' | 'yield' | 'await'\n", "'with' | 'implements'\n")
    .replace("assign := arrow | 'yield' ('*'? assign)? |", "assign := arrow | 'yield' '*' assign | 'yield' assign |")
)
TYPESCRIPT = _fill(_JS, _TYPED) + _TS_EXTRA

# ---------------------------------------------------------------- Go

GO = r"""
file := ('package' NAME ';' | top ';')+
rest := (top ';' | stmt ';' | '}' ';')+
top := 'import' (impspec | '(' (impspec ';')* impspec? ')') | decl | func
impspec := ('.' | NAME)? STR
decl := 'const' group | 'var' group | 'type' tgroup
group := spec | '(' (spec ';')* spec? ')'
spec := NAME (',' NAME)* (type ('=' exprs)? | '=' exprs)?
tgroup := tspec | '(' (tspec ';')* tspec? ')'
tspec := NAME tparams? '='? type
tparams := '[' tparam (',' tparam)* ','? ']'
tparam := NAME (',' NAME)* constraint
constraint := '~'? type ('|' '~'? type)*
func! := 'func' ('(' params? ')')? NAME tparams? '('! params? ')' result? block?
result := type | '(' params? ')'
params := param (',' param)* ','?
param := '...' type | type ('...'? type)?
type := NAME ('.' NAME)? targs? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' '(' params? ')' result? | struct | iface | '(' type ')'
targs := '[' type (',' type)* ','? ']'
struct := 'struct' '{' (field ';')* field? '}'
field := (NAME (',' NAME)* type | '*'? NAME ('.' NAME)? targs?) STR?
iface := 'interface' '{' (method ';')* method? '}'
method := NAME '(' params? ')' result? | constraint
block := '{' (stmt ';')* stmt? '}'
stmt := ';' | decl | simple (':' stmt?)? | 'go' expr | 'defer' expr | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | block | if | switch | select | for
if := 'if' cheads block ('else' (if | block))?
cheads := (csimple? ';')? csimple
switch := 'switch' (csimple? ';')? csimple? '{' caseclause* '}'
caseclause := ('case' types | 'default') ':' (stmt ';')* stmt?
types := (expr | type) (',' (expr | type))*
select := 'select' '{' (('case' simple | 'default') ':' (stmt ';')* stmt?)* '}'
for := 'for' forhead? block
forhead := cexprs ((':=' | '=') ('range' cexpr | cexprs forrest?) | asop2 cexprs forrest? | ('++' | '--') forrest? | forrest)? | 'range' cexpr | forrest
forrest := ';' cexpr? ';' csimple?
asop2 := '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
simple := exprs ((':=' | asop) exprs | '++' | '--' | '<-' expr)?
csimple := cexprs ((':=' | asop) cexprs | '++' | '--' | '<-' cexpr)?
asop := '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
exprs := expr (',' expr)*
cexprs := cexpr (',' cexpr)*
binop := '+' | '-' | '*' | '/' | '%' | '&&' | '||' | '&' | '|' | '^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '&^'
unop := '+' | '-' | '!' | '^' | '*' | '&' | '<-'
expr := unop* postfix (binop unop* postfix)*
cexpr := unop* cpostfix (binop unop* cpostfix)*
postfix := primary trailer*
cpostfix := cprimary ctrailer*
trailer := '.' (NAME | '(' (type | 'type') ')') | '[' index ']' | '(' args? ')' | literal
ctrailer := '.' (NAME | '(' (type | 'type') ')') | '[' index ']' | '(' args? ')'
index := (expr | ltype) (',' (expr | ltype))* | expr? ':' expr? (':' expr)?
args := arg (',' arg)* ','?
arg := (expr | ltype) '...'?
ltype := '[' ']' type | 'map' '[' type ']' type | 'chan' type | struct | iface | '*' type | 'func' '(' params? ')' result?
primary := NAME | NUM | STR | '(' (expr | type) ')' | 'func' '(' params? ')' result? block | arrtype literal | arrtype '(' expr ')' | struct literal
cprimary := NAME | NUM | STR | '(' (expr | type) ')' | 'func' '(' params? ')' result? block | arrtype literal | arrtype '(' expr ')'
arrtype := '[' (expr | '...')? ']' type | 'map' '[' type ']' type | iface | 'chan' type
literal := '{' (elem (',' elem)*)? ','? '}'
elem := value (':' value)?
value := expr | literal
"""

# ---------------------------------------------------------------- Rust

_RUST = r"""
file := innerattr* item+
rest := (item | 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | attr* nexpr ';' | attr* blocklike | '}' | ';')+
innerattr := '#' '!' '[' tree* ']'
attr := '#' '[' tree* ']'
tree := '(' tree* ')' | '[' tree* ']' | '{' tree* '}' | NAME | NUM | STR | LIFE | kw | punct
kw := 'fn' | 'pub' | 'use' | 'mod' | 'struct' | 'enum' | 'impl' | 'trait' | 'for' | 'if' | 'else' | 'match' | 'let' | 'mut' | 'ref' | 'return' | 'self' | 'Self' | 'super' | 'crate' | 'where' | 'while' | 'loop' | 'in' | 'as' | 'const' | 'static' | 'type' | 'unsafe' | 'async' | 'await' | 'move' | 'dyn' | 'extern' | 'break' | 'continue' | 'true' | 'false' | 'union' | 'macro_rules'
punct := ',' | ';' | ':' | '::' | '.' | '..' | '...' | '..=' | '=' | '==' | '!=' | '!' | '<' | '>' | '<=' | '>=' | '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '->' | '=>' | '#' | '$' | '?' | '@' | '~' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<' | '<<='
id := NAME | 'union'
vis := 'pub' ('(' ('in'? path) ')')?
item! := attr* vis? (kind | path '!' delim ';'?) | innerattr
kind := 'use' usetree ';' | 'mod' id (';' | '{' item* '}') | 'extern' 'crate' id ('as' id)? ';' | ('static' 'mut'? | 'const') (id | '_') (':' type)? ('=' expr)? ';' | 'type' id generics? (':' bounds)? where? ('=' type)? where? ';'
  | fn | 'struct' id generics? (where? fields | tuple where? ';' | where? ';') | ('union') id generics? where? fields | 'enum' id generics? where? '{' (variant (',' variant)*)? ','? '}'
  | 'unsafe'? 'trait' id generics? (':' bounds)? where? '{' assoc* '}' | 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? '{' assoc* '}' | 'unsafe'? 'extern' STR? '{' assoc* '}' | 'macro_rules' '!' id delim ';'?
assoc := item
delim := '(' tree* ')' | '{' tree* '}' | '[' tree* ']'
usetree := ('::')? (useseg ('::' (useseg | '*' | '{' (usetree (',' usetree)*)? ','? '}'))* | '*' | '{' (usetree (',' usetree)*)? ','? '}') ('as' (id | '_'))?
useseg := id | 'crate' | 'self' | 'super' | 'Self'
fn! := ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' id generics? '('! (fparam (',' fparam)*)? ','? ')' ('->' type)? where? (block | ';')
fparam := attr* (('&' LIFE?)? 'mut'? 'self' (':' type)? | pattern ':' type | '...')
generics := '<' (gparam (',' gparam)*)? ','? '>'
gparam := attr* (LIFE (':' LIFE ('+' LIFE)*)? | id (':' bounds?)? ('=' type)? | 'const' id ':' type ('=' expr)?)
where := 'where' wpred (',' wpred)* ','?
wpred := ('for' generics)? type ':' bounds | LIFE ':' LIFE ('+' LIFE)*
bounds := bound ('+' bound)*
bound := '?'? ('for' generics)? path | LIFE | '(' bound ')'
fields := '{' (field (',' field)*)? ','? '}'
field := attr* vis? id ':' type
tuple := '(' (tfield (',' tfield)*)? ','? ')'
tfield := attr* vis? type
variant := attr* id (fields | tuple)? ('=' expr)?
type := path | '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '(' (type (',' type)*)? ','? ')' | '[' type (';' expr)? ']' | '!' | '_' | ('dyn' | 'impl') bounds | ('for' generics)? ('unsafe' | 'extern' STR?)* 'fn' '(' (ftype (',' ftype)*)? ','? ')' ('->' type)? | '<' type ('as' path)? '>' ('::' seg)+ | path '!' delim
ftype := (id ':')? type
path := '::'? seg ('::' (seg | targs))*
seg := (id | 'self' | 'Self' | 'super' | 'crate') (targs | '(' (type (',' type)*)? ')' ('->' type)?)?
targs := '<' (targ (',' targ)*)? ','? '>'
targ := LIFE | type (('=' | ':') bounds)? | NUM | STR | block | '-' NUM | 'true' | 'false'
epath := '::'? eseg ('::' (eseg | targs))* | '<' type ('as' path)? '>' ('::' (eseg | targs))+
eseg := id | 'self' | 'Self' | 'super' | 'crate'
pattern := '|'? pat1 ('|' pat1)*
pat1 := ('&' | '&&')? pprim
pprim := '_' | '..' | '-'? (NUM | STR) prange? | 'true' | 'false' | ('ref' 'mut'? | 'mut') id ('@' pat1)? | epath ('@' pat1 | prange | '(' (pattern (',' pattern)*)? ','? ')' | '{' (fpat (',' fpat)*)? ','? '}' | '!' delim)? | '(' (pattern (',' pattern)*)? ','? ')' | '[' (pattern (',' pattern)*)? ','? ']' | '..=' plit | 'box' pat1
prange := ('..=' | '..' | '...') plit?
plit := '-'? (NUM | STR) | epath
fpat := attr* ('..' | 'ref'? 'mut'? id (':' pattern)? | NUM ':' pattern)
block := '{' innerattr* (stmt | attr* nexpr ';')* nexpr? '}'
stmt := ';' | attr* vis? kind | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | attr* blocklike (('.' (id | NUM | 'await') ('::' targs)? | '?') trailer* ('as' type)* (binop ux)* (asop expr)?)?
nexpr := nux (binop ux)* (asop expr | rangeop ux? (binop ux)*)? | rangeop (ux (binop ux)*)?
nux := (unop+ postx | nprimx trailer*) ('as' type)*
nprimx := lit | epath (sfields | '!' delim)? | paren | closure | lastx
expr := %E%
cexpr := %C%
lastx := 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | 'yield' expr?
closure := ('static' | 'async' | 'move')* ('||' | '|' (cparam (',' cparam)*)? ','? '|') ('->' type block | expr)
cparam := pat1 (':' type)?
asop := '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>='
binop := '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>'
unop := '-' | '*' | '!' | '&' 'mut'? | '&' 'raw' ('const' | 'mut') | '&&' 'mut'?
trailer := '.' (id | NUM | 'await') ('::' targs)? | '(' (expr (',' expr)*)? ','? ')' | '[' expr ']' | '?'
blocklike := LIFE ':' loops | loops | 'if' cexpr block ('else' ifelse)? | 'match' cexpr '{' innerattr* arm* '}' | ('unsafe' | 'const' | 'async' 'move'?)? block
ifelse := block | 'if' cexpr block ('else' ifelse)?
loops := 'loop' block | 'while' cexpr block | 'for' pattern 'in' cexpr block | block
arm := attr* pattern ('if' expr)? '=>' (expr ','? )
lit := NUM | STR | 'true' | 'false'
paren := '(' (expr (',' expr)*)? ','? ')' | '[' (expr (',' expr)* (';' expr)?)? ','? ']'
sfields := '{' (sfield (',' sfield)*)? ','? '}'
sfield := attr* ('..' expr? | (id | NUM) (':' expr)?)
letx := 'let' pattern '='
ux := letx? unop* postx ('as' type)*
cux := letx? unop* cpostx ('as' type)*
postx := primx trailer*
cpostx := cprimx trailer*
primx := lit | epath (sfields | '!' delim)? | paren | blocklike | closure | lastx
cprimx := lit | epath ('!' delim)? | paren | blocklike | closure | lastx
rangeop := '..' | '..='
"""
RUST = _RUST.replace("%E%", "ux (binop ux)* (asop expr | rangeop ux? (binop ux)*)? | rangeop (ux (binop ux)*)?").replace("%C%", "cux (binop cux)* (asop cexpr | rangeop cux? (binop cux)*)? | rangeop (cux (binop cux)*)?")

# ---------------------------------------------------------------- Python

PYTHON = r"""
file := (stmt | NL)+
rest := (stmt | NL | INDENT | DEDENT)+
stmt := simple (';' simple)* ';'? NL | compound
compound := 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)? | 'while' named ':' suite ('else' ':' suite)? | for | try | with | func | class | decorated | 'async' (func | with | for) | match
for := 'for' targets 'in' stars ':' suite ('else' ':' suite)?
try := 'try' ':' suite (('except' '*'? (test ((',' test)+ | 'as' id)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite)
with := 'with' (witem (',' witem)* | '(' witem (',' witem)* ','? ')') ':' suite
witem := test ('as' target)?
func! := 'def' id tparams? '('! params? ')' ('->' stars)? ':'! suite
class := 'class' id tparams? ('(' args? ')')? ':' suite
tparams := '[' tparam (',' tparam)* ','? ']'
tparam := ('*' | '**')? id (':' test)? ('=' test)?
decorated! := ('@' named NL)+ ('async'? func | class)
match := 'match' stars ':' NL INDENT ('case' patterns ('if' named)? ':' suite)+ DEDENT
patterns := pattern (',' pattern)* ','?
pattern := orpat ('as' id)?
orpat := pat ('|' pat)*
pat := '*' id | '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | id ('.' id)* ('(' (parg (',' parg)*)? ','? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' (ppair (',' ppair)*)? ','? '}'
parg := (id '=')? pattern
ppair := '**' id | ('-'? NUM | STR+ | 'None' | 'True' | 'False' | id ('.' id)*) ':' pattern
suite := simple (';' simple)* ';'? NL | NL INDENT stmt+ DEDENT
id := NAME | 'match' | 'case' | 'type' | 'print' | 'exec'
simple := 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (test ('from' test)?)? | 'global' id (',' id)* | 'nonlocal' id (',' id)* | 'del' targets | 'assert' test (',' test)? | import | 'type' id tparams? '=' test
  | stars (':' test ('=' (stars | yield))? | augop (stars | yield) | ('=' (stars | yield))*) | yield
import := 'import' dotted ('as' id)? (',' dotted ('as' id)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | names | '(' names ','? ')')
names := id ('as' id)? (',' id ('as' id)?)*
dotted := id ('.' id)*
augop := '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
targets := target (',' target)* ','?
target := '*'? postfix
stars := star (',' star)* ','?
star := '*' bits | named
named := test (':=' test)?
yield := 'yield' ('from' test | stars)?
test := lambda | ors ('if' ors 'else' test)?
lambda := 'lambda' lparams? ':' test
ors := nots (('and' | 'or') nots)*
nots := 'not'* bits (cmp 'not'* bits)*
cmp := '<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?
bits := unary (binop unary)*
binop := '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**'
unary := ('+' | '-' | '~')* 'await'? postfix
postfix := atom trailer*
trailer := '.' id | '(' args? ')' | '[' subs ']'
subs := sub (',' sub)* ','?
sub := '*' bits | named? ':' test? (':' test?)? | named
args := arg (',' arg)* ','?
arg := '*' test | '**' test | named (comp | '=' test)?
comp := ('async'? 'for' targets 'in' ors ('if' nocond)*)+
nocond := lambda | named
atom := id | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' (yield | star (comp | (',' star)* ','?))? ')' | '[' (star (comp | (',' star)* ','?))? ']' | '{' (dict | set)? '}'
dict := pair (comp | (',' pair)* ','?)
pair := '**' bits | test ':' test
set := star (comp | (',' star)* ','?)
params := param (',' param)* ','?
param := '/' | '*' (id (':' star)?)? | '**' id (':' test)? | id (':' test)? ('=' test)?
lparams := lparam (',' lparam)* ','?
lparam := '/' | '*' id? | '**' id | id ('=' test)?
"""

#: Python before 3.7: ``async`` and ``await`` are names where they head nothing, and there is no
#: ``match``, no assignment within expressions, no positional-only parameter, no ``except*``.
PYTHON_OLD = PYTHON
for _new, _old in (
    (" | match\n", "\n"),
    ("id := NAME | 'match' | 'case' | 'type' | 'print' | 'exec'", "id := NAME | 'match' | 'case' | 'type' | 'print' | 'exec' | 'async' | 'await'"),
    ("named := test (':=' test)?", "named := test"),
    ("param := '/' | '*'", "param := '*'"),  # of lambdas, too
    ("'except' '*'? (", "'except' ("),
    (" | 'type' id tparams? '=' test\n", "\n"),
    ("'def' id tparams? '('!", "'def' id '('!"),
    ("'class' id tparams? (", "'class' id ("),
):
    if _new not in PYTHON_OLD:
        raise ValueError(f"grammar: {_new}")
    PYTHON_OLD = PYTHON_OLD.replace(_new, _old)

# ---------------------------------------------------------------- data languages

JSON = r"""
file := value
value := object | array | STR | NUM | 'true' | 'false' | 'null'
object := '{' (STR ':' value (',' STR ':' value)*)? '}'
array := '[' (value (',' value)*)? ']'
"""

TOML = r"""
file := NL* (line (NL+ line)*)? NL*
line := table | pair
table := '[' ('[' key ']' | key) ']'
pair := key '=' value
key := name ('.' name)*
name := BARE | STR | NUM | 'true' | 'false' | DATE
value := STR | NUM | DATE | 'true' | 'false' | array | inline | FLOAT
array := '[' NL* (value NL* (',' NL* value NL*)* (',' NL*)?)? ']'
inline := '{' (pair (',' pair)*)? '}'
""".replace("file := NL* (line (NL+ line)*)? NL*", "file := NL | NL* line (NL+ line)* NL*")

YAML = r"""
file := DIRECTIVE* (node | MARK node?) (MARK node?)*
node := mapping | sequence | scalar | flow NL
scalar := SCALAR NL (SCALAR NL)* (INDENT (SCALAR NL)+ DEDENT)?
mapping := entry+
entry := '?' value (':' value)? | KEY value
value := SCALAR NL cont? | flow NL | NL (INDENT node DEDENT | sequence)? | INDENT node DEDENT
cont := INDENT (SCALAR NL)+ (INDENT (SCALAR NL)+ DEDENT)? DEDENT
sequence := ('-' item)+
item := SCALAR NL cont? | flow NL | NL (INDENT node DEDENT)? | INDENT node DEDENT
flow := '[' (fitem (',' fitem)*)? ','? ']' | '{' (fpair (',' fpair)*)? ','? '}'
fitem := KEY? fvalue | KEY
fvalue := SCALAR | flow
fpair := KEY fvalue? | SCALAR
"""

CSS = r"""
file := (item | ';')+
item := AT pre* (';' | '{' body* '}') | sel+ '{' body* '}' | CDATA
sel := IDENT | HASH | NUM | STR | '.' | ':' | ',' | '>' | '+' | '~' | '*' | '&' | '|' | '=' | '^' | '$' | '(' soup* ')' | '[' soup* ']' | '%' | '-' | '/'
pre := IDENT | HASH | NUM | STR | ':' | ',' | '>' | '<' | '=' | '.' | '*' | '(' soup* ')' | '[' soup* ']' | '%' | '-' | '/' | '+' | '&' | '~'
soup := sel | '@' | ';' | '!' | '{' soup* '}' | '#' | '<' | '?'
body := ';' | decl | item
decl := '*'? IDENT ':' value+ ('!' IDENT)? (';' | END)
value := IDENT | HASH | NUM | STR | ',' | '/' | '.' | '+' | '-' | '*' | '%' | ':' | '=' | '(' soup* ')' | '[' soup* ']' | '{' soup* '}'
"""

SQL = r"""
file := (stmt? ';')* stmt?
stmt := select | insert | update | delete | create | other
select := ('with' 'recursive'? cte (',' cte)*)? qexpr
cte := name ('(' names ')')? 'as' ('materialized' | 'not' 'materialized')? '(' (select | insert | update | delete) ')'
qexpr := qterm (('union' | 'except' | 'intersect' | 'minus') ('all' | 'distinct')? qterm)* orderby? limits*
qterm := 'select' ('distinct' ('on' '(' exprs ')')? | 'all')? ('top' NUM)? cols ('into' name)? ('from' tables)? where? ('group' 'by' ('all' | exprs ('with' name)?))? ('having' expr)? ('qualify' expr)? ('window' name 'as' '(' soup* ')')? | 'values' rows | '(' select ')' | 'table' path
cols := col (',' col)*
col := expr ('as'? (alias | STR))?
alias := name
tables := tref (',' tref)*
tref := tprim (join)*
join := ('natural' | 'cross' | 'inner' | ('left' | 'right' | 'full') 'outer'?)* 'join' 'lateral'? tprim ('on' expr | 'using' '(' names ')')? | ('cross' | 'outer') 'apply' tprim
tprim := 'lateral'? (path ('(' args? ')')? | '(' (select | tref) ')' | 'unnest' '(' args ')') ('for' soup)? ('tablesample' soup+)? ('as'? name ('(' names ')')?)?
where := 'where' expr
orderby := 'order' 'by' okey (',' okey)*
okey := expr ('asc' | 'desc')? ('nulls' ('first' | 'last'))?
limits := 'limit' expr (',' expr)? | 'offset' expr ('rows' | 'row')? | 'fetch' ('first' | 'next') expr? ('rows' | 'row') 'only' | 'for' ('update' | 'share')
insert := ('insert' | 'replace') ('or' ('replace' | 'ignore'))? 'ignore'? ('into' | 'overwrite')? 'table'? path ('as'? name)? ('(' paths ')')? ('values' rows | select | 'default' 'values' | 'set' sets) ('on' soupflat+)? ('returning' cols)?
rows := row (',' row)*
row := '(' (rexpr (',' rexpr)*)? ')'
rexpr := expr | 'default'
update := 'update' path ('as'? name)? 'set' sets ('from' tables)? where? ('returning' cols)?
sets := set1 (',' set1)*
set1 := (path | '(' names ')') '=' rexpr
delete := 'delete' 'from' path ('as'? name)? ('using' tables)? where? ('returning' cols)?
create := 'create' ('or' 'replace')? ('temp' | 'temporary' | 'global' | 'local' | 'unique' | 'external' | 'unlogged')* ( 'table' ('if' 'not' 'exists')? path (tdef soupflat* ('as' select)? | 'as' select | 'like' path) | ('view' | 'materialized' 'view') ('if' 'not' 'exists')? path ('(' names ')')? 'as' select | 'index' 'concurrently'? ('if' 'not' 'exists')? path? 'on' path ('using' name)? '(' okey (',' okey)* ')' soupflat* where? | generic )
tdef := '(' titem (',' titem)* ','? ')'
titem := 'like' path | ('constraint' name)? tconstraint | name ctype? cconstraint*
tconstraint := ('primary' 'key' | 'unique' ('key' | 'index')? name? | 'foreign' 'key' name?) '(' okey (',' okey)* ')' ref? soupflat* | 'check' '(' expr ')' | ('index' | 'key') name? '(' okey (',' okey)* ')'
ref := 'references' path ('(' names ')')? ('on' ('delete' | 'update') ('cascade' | 'restrict' | 'set' ('null' | 'default') | 'no' 'action'))*
ctype := name+ ('(' args ')')? (name)* ('[' NUM? ']')*
cconstraint := ('constraint' name)? ('not' 'null' | 'null' | 'primary' 'key' | 'unique' | 'default' (unaryx | '(' expr ')') | 'check' '(' expr ')' | ref | 'collate' path | 'generated' soupflat+ | 'comment' STR | 'on' 'update' unaryx)
generic := word soupflat*
other := ('alter' | 'drop' | 'grant' | 'revoke' | 'set' | 'use' | 'begin' | 'commit' | 'rollback' | 'truncate' | 'comment' | 'analyze' | 'vacuum' | 'explain' | 'show' | 'describe' | 'call' | 'exec' | 'execute' | 'merge' | 'lock' | 'declare' | 'copy' | 'pragma' | 'start' | 'savepoint' | 'release' | 'refresh' | 'attach' | 'detach' | 'do' | 'go' | 'end' | 'load' | 'cache' | 'prepare' | 'deallocate' | 'reindex') (soupflat* soupend)?
word := name | 'on' | 'in' | 'is' | 'as' | 'not' | 'null' | 'set' | 'values' | 'table' | 'view' | 'index' | 'select' | 'from' | 'where' | 'group' | 'order' | 'by' | 'and' | 'or' | 'primary' | 'key' | 'unique' | 'default' | 'check' | 'references' | 'using' | 'into' | 'all' | 'distinct' | 'with' | 'having' | 'limit' | 'union' | 'join' | 'case' | 'when' | 'then' | 'else' | 'end' | 'like' | 'between' | 'exists' | 'foreign' | 'constraint' | 'update' | 'delete' | 'insert' | 'create' | 'returning' | 'interval' | 'cast' | 'asc' | 'desc' | 'left' | 'right' | 'full' | 'inner' | 'outer' | 'cross' | 'natural' | 'alter' | 'drop' | 'grant' | 'use' | 'call' | 'execute' | 'cascade' | 'collate' | 'window' | 'over' | 'do' | 'begin' | 'to' | 'if' | 'some' | 'any'
soupflat := word | STR | NUM | PARAM | op | '=' | ',' | '.' | ':' | '*' | '(' soup* ')' | '[' soup* ']' | '{' soup* '}' | '@'
soupend := name | STR | NUM | PARAM | '(' soup* ')' | 'null' | 'default' | 'cascade' | 'end' | 'all' | 'on' | '*'
soup := soupflat | ';'
name := NAME | 'first' | 'last' | 'row' | 'rows' | 'only' | 'next' | 'replace' | 'ignore' | 'temp' | 'temporary' | 'global' | 'local' | 'external' | 'unlogged' | 'comment' | 'show' | 'start' | 'release' | 'load' | 'cache' | 'materialized' | 'recursive' | 'minus' | 'action' | 'no' | 'restrict' | 'share' | 'generated' | 'concurrently' | 'overwrite' | 'top' | 'top' | 'copy' | 'go' | 'truncate' | 'analyze' | 'explain' | 'describe' | 'exec' | 'merge' | 'lock' | 'declare' | 'pragma' | 'savepoint' | 'refresh' | 'attach' | 'detach' | 'prepare' | 'deallocate' | 'reindex' | 'vacuum' | 'filter' | 'within' | 'nulls' | 'offset' | 'apply' | 'qualify' | 'set' | 'values' | 'key' | 'index' | 'view' | 'date' | 'time' | 'timestamp' | 'escape' | 'separator' | 'unnest' | 'lateral' | 'commit' | 'rollback' | 'revoke' | 'fetch' | 'ilike' | 'rlike' | 'regexp' | 'glob' | 'similar' | 'div' | 'mod' | 'tablesample'
path := name ('.' (name | '*'))*
paths := path (',' path)*
names := name (',' name)*
exprs := expr (',' expr)*
args := 'distinct'? arg (',' arg)* orderby? ('separator' STR)?
arg := '*' | select | expr ('as' ctype)? ('from' expr)? ('for' expr)? | 'all'
expr := 'not'* pred (('and' | 'or') 'not'* pred)*
pred := sum test*
test := ('=' | op | 'is' 'not'? 'distinct' 'from') ('any' | 'all' | 'some')? sum | 'is' 'not'? ('null' | 'true' | 'false' | 'unknown' | name) | 'not'? ('like' | 'ilike' | 'rlike' | 'regexp' | 'glob' | 'similar' 'to') sum ('escape' sum)? | 'not'? 'between' sum 'and' sum | 'not'? 'in' ('(' (select | exprs)? ')' | path | PARAM)
sum := unaryx (('*' | op1 | 'div' | 'mod') unaryx)*
unaryx := op1* atom post*
post := '::' ctype | '[' (expr? ':'? expr?) ']' | 'over' (name | '(' soup* ')') | 'filter' '(' where ')' | 'within' 'group' '(' orderby ')' | 'at' name name sum | 'collate' path | '.' (name | '*')
atom := STR+ | NUM | PARAM | 'null' | 'true' | 'false' | path ('(' args? ')')? STR? | '(' (select | exprs)? ')' | 'case' expr? ('when' expr 'then' expr)+ ('else' expr)? 'end' | 'cast' '(' expr 'as' ctype ')' | 'exists' '(' select ')' | 'interval' atom name? | '*' | ('left' | 'right' | 'if' | 'any' | 'all' | 'replace') '(' args? ')' | 'array' '[' exprs? ']' | '{' soup* '}' | ':' name | '@' '@'? path
op := '<' | '>' | '<=' | '>=' | '<>' | '!=' | '==' | '~' | '!~' | '~*' | '@>' | '<@' | '&&' | '<=>'
op1 := '+' | '-' | '/' | '%' | '||' | '|' | '&' | '^' | '#' | '->' | '->>' | '<<' | '>>' | '?'
""".replace("unaryx := op1*", "unaryx := ('+' | '-')*").replace("post := '::' ctype | '[' (expr? ':'? expr?) ']'", "post := '::' ctype | '[' (expr (':' expr?)? | ':' expr?) ']'").replace("file := (stmt? ';')* stmt?", "file := (stmt? ';')+ stmt? | stmt").replace("test := ('='", "test := ('='")

#: Names may stand in brackets.
TSQL = SQL.replace("name := NAME |", "name := NAME | '[' (NAME | 'key' | 'index' | 'order' | 'user' | 'group' | 'date')+ ']' |")

BASH = r"""
file := (NL | list)+
rest := (NL | list | '}' | ')' | ';' | 'fi' | 'done' | 'esac' | ';;')+
list := andor ((';' | '&' | NL) NL* andor)* (';' | '&')?
andor := pipe (('&&' | '||') NL* pipe)*
pipe := '!'? cmd (('|' | '|&') NL* cmd)*
cmd := simple | compound redir* | 'function' word ('(' ')')? NL* compound | fdef
fdef! := WORD '('! ')' NL* compound
simple := (ASSIGN | redir)+ ((WORD | '[[' | 'time') (arg | redir)*)? | (WORD | TEST) (arg | redir | '(' arg* ')')*
arg := WORD | ASSIGN | TEST | 'if' | 'then' | 'else' | 'elif' | 'fi' | 'for' | 'in' | 'do' | 'done' | 'while' | 'until' | 'case' | 'esac' | 'function' | '{' | '}' | '!' | 'select' | 'time' | '[[' | ']]'
word := WORD | ASSIGN
redir := REDIR (WORD | ASSIGN | TEST) | DUP | HEREDOC
compound := '{' body '}' | '(' body ')' | ARITH | 'if' body 'then' body ('elif' body 'then' body)* ('else' body)? 'fi' | ('while' | 'until') body 'do' body 'done'
  | ('for' | 'select') (WORD (NL* 'in' arg*)? | ARITH) (';' | NL) NL* 'do' body 'done' | ('for' | 'select') ARITH? WORD? 'do' body 'done' | 'case' arg NL* 'in' NL* caseitem* 'esac' | '[[' targ+ ']]'
targ := arg1 | '&&' | '||' | '(' | ')' | REDIR | NL | '!' | '|'
arg1 := WORD | ASSIGN | TEST | 'in' | 'if' | 'for' | 'do' | 'done'
caseitem := '('? arg1 ('|' arg1)* ')' (body | NL*) (';;' | ';&' | ';;&') NL*
body := NL* list (NL | ';')*
""".replace("caseitem := '('? arg1 ('|' arg1)* ')' (body | NL*)", "caseitem := '('? arg1 ('|' arg1)* ')' NL* (list (NL | ';')*)?").replace("body := NL* list (NL | ';')*", "body := NL* list (NL | ';')*")


# ---------------------------------------------------------------- layouts


def _enders(terminals, words):
    return {terminals[w] for w in words if w in terminals}


def go_layout(lexemes, kinds, terminals):
    """Puts in the semicolons that line ends stand for."""
    ends = _enders(terminals, ["NAME", "NUM", "STR", "return", "break", "continue", "fallthrough", "++", "--", ")", "]", "}"])
    semi = terminals[";"]
    out, at = [], []
    for j, k in enumerate(map(kinds.__getitem__, lexemes)):
        if k >= 0:
            out.append(k)
            at.append(j)
        elif k == NEWLINE and out and out[-1] in ends:
            out.append(semi)
            at.append(j)
    if out and out[-1] in ends:
        out.append(semi)
        at.append(len(lexemes) - 1)
    out.append(EOF)
    return out, at


_JS_NOT_BEFORE = ["{", ".", "?.", "(", "[", ",", ";", ")", "]", "}", "=", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", "=>", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "+=", "-=", "*=", "/=", "|", "&", "^", "in", "instanceof", "else", "catch", "finally", "as", "of", "from", "extends", "implements"]


def js_layout(lexemes, kinds, terminals):
    """Marks line ends at which a statement may end."""
    ends = _enders(terminals, ["NAME", "NUM", "STR", "REGEX", ")", "]", "}", "return", "break", "continue", "++", "--", "this", "super", "null", "true", "false", "void", "debugger", "string", "number", "boolean", "any", "unknown", "never", "object", "type", "of", "get", "set", "async", "let", "static", "undefined", "symbol", "!", "as", "from", "module", "target", "meta", "PRIVATE"])
    bad = _enders(terminals, _JS_NOT_BEFORE)
    asi = terminals["ASI"]
    out, at, line = [], [], False
    for j, k in enumerate(map(kinds.__getitem__, lexemes)):
        if k >= 0:
            if line:
                line = False
                if out and out[-1] in ends and k not in bad:
                    if out[-1] != terminals[")"] or not _heads_statement(out, terminals):
                        out.append(asi)
                        at.append(j)
            out.append(k)
            at.append(j)
        elif k == NEWLINE:
            line = True
    if out and out[-1] in ends:
        out.append(asi)
        at.append(len(lexemes) - 1)
    out.append(EOF)
    return out, at


def _heads_statement(out, terminals) -> bool:
    """True if the closing parenthesis at the end belongs to ``if (...)``, ``for (...)`` or ``while (...)``."""
    opening, closing, depth = terminals["("], terminals[")"], 0
    for j in range(len(out) - 1, -1, -1):
        depth += (out[j] == closing) - (out[j] == opening)
        if not depth:
            return j > 0 and out[j - 1] in (terminals["if"], terminals["for"], terminals["while"])
    return False


def python_layout(lexemes, kinds, terminals):
    """Line ends outside brackets, and the changes of indentation."""
    nl, ind, ded = terminals["NL"], terminals["INDENT"], terminals["DEDENT"]
    opens = _enders(terminals, ["(", "[", "{"])
    closes = _enders(terminals, [")", "]", "}"])
    out, at, stack, depth, pending = [], [], [], 0, ""
    for j, k in enumerate(map(kinds.__getitem__, lexemes)):
        if k >= 0:
            if pending is not None:
                col = len(pending.expandtabs(8))
                pending = None
                if not stack:
                    stack.append(col)
                else:
                    if out and out[-1] not in (nl, ded):
                        out.append(nl)
                        at.append(j)
                    if col > stack[-1]:
                        stack.append(col)
                        out.append(ind)
                        at.append(j)
                    else:
                        while col < stack[-1] and len(stack) > 1:
                            stack.pop()
                            out.append(ded)
                            at.append(j)
                        if col != stack[-1]:
                            out.append(ERROR)
                            at.append(j)
            out.append(k)
            at.append(j)
            if k in opens:
                depth += 1
            elif k in closes:
                depth -= 1
        elif k == NEWLINE and depth <= 0:
            pending = lexemes[j][1:]
    if out:
        out.append(nl)
        at.append(len(lexemes) - 1)
        for _ in stack[1:]:
            out.append(ded)
            at.append(len(lexemes) - 1)
    out.append(EOF)
    return out, at


def line_layout(lexemes, kinds, terminals):
    """Line ends as tokens, runs of them as one."""
    nl = terminals["NL"]
    out, at = [], []
    for j, k in enumerate(map(kinds.__getitem__, lexemes)):
        if k == NEWLINE:
            if out and out[-1] != nl:
                out.append(nl)
                at.append(j)
        elif k >= 0:
            out.append(k)
            at.append(j)
    if len(out) == 1 and out[0] == nl:
        out = []
    out.append(EOF)
    return out, at


def css_layout(lexemes, kinds, terminals):
    """The last declaration before a closing brace may lack its semicolon: a token stands for it."""
    close, end, semi, opening = terminals["}"], terminals["END"], terminals[";"], terminals["{"]
    out, at = [], []
    for j, k in enumerate(map(kinds.__getitem__, lexemes)):
        if k >= 0:
            if k == close and out and out[-1] not in (semi, close, opening):
                out.append(end)
                at.append(j)
            out.append(k)
            at.append(j)
    out.append(EOF)
    return out, at


_YAML_FLOW = re.compile(r"""[ \t]+|\#[^\n]*|[\[\]{},]|(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},:"'#][^\[\]{},:\n]*(?::(?![\s,\]}])[^\[\]{},:\n]*)*)\s*:(?=[\s,\]}]|$)|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},][^\[\]{},\n]*?(?=\s+\#|\s*[\[\]{},\n]|\s*$)|\S""", re.M)
_YAML_KEY = re.compile(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^\s#\[\]{},&*!|>'"%@`?:-]|[?:-](?=\S))[^\n]*?)\s*:(?=\s|$)""")
_YAML_PROPS = re.compile(r"(?:[&!][^\s\[\]{},]*\s+)+|[&!][^\s\[\]{},]*$")
_YAML_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?\s*(?:#.*)?$")


def yaml_tokens(text: str, terminals) -> list[int]:
    """Block structure of a YAML text as tokens."""
    t = terminals
    key, scalar, nl, ind, ded = t["KEY"], t["SCALAR"], t["NL"], t["INDENT"], t["DEDENT"]
    out: list[int] = []
    stack = [0]
    lines = text.replace("\r\n", "\n").split("\n")
    i = 0

    def to(col):
        while col < stack[-1] and len(stack) > 1:
            stack.pop()
            out.append(ded)
        if col > stack[-1]:
            stack.append(col)
            out.append(ind)
        elif col != stack[-1]:
            out.append(ERROR)

    while i < len(lines):
        line = lines[i]
        i += 1
        body = line.lstrip(" ")
        if not body.strip() or body.lstrip()[0] == "#":
            continue
        col = len(line) - len(body)
        if col == 0 and (body.startswith("---") or body.rstrip() == "...") and (len(body) == 3 or body[3] in " \t\r"):
            while len(stack) > 1:
                stack.pop()
                out.append(ded)
            out.append(t["MARK"])
            body = body[3:].strip()
            if not body or body[0] == "#":
                continue
            col = 0
        elif col == 0 and body[0] == "%" and not out:
            out.append(t["DIRECTIVE"])
            continue
        if body[0] == "\t":
            out.append(ERROR)
            continue
        to(col)
        parent = col
        while True:
            if body.startswith("- ") or body.rstrip() == "-":
                out.append(t["-"])
                rest = body[1:]
                body = rest.lstrip(" ")
                if not body.strip() or body[0] == "#":
                    out.append(nl)
                    break
                parent, col = col, col + 1 + len(rest) - len(body)
                if body.startswith("- ") or _YAML_KEY.match(body):
                    stack.append(col)
                    out.append(ind)
                    continue
            m = _YAML_KEY.match(body)
            if m:
                out.append(key)
                parent = col
                body = body[m.end() :].strip()
                if not body or body[0] == "#":
                    out.append(nl)
                    break
            props = _YAML_PROPS.match(body)
            if props:
                body = body[props.end() :].strip()
                if not body or body[0] == "#":
                    out.append(nl)
                    break
            if _YAML_BLOCK.match(body):
                while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > parent):
                    i += 1
                out += [scalar, nl]
                break
            if body[0] in "[{":
                depth = 0
                whole = body
                while True:
                    depth = 0
                    for x in _YAML_FLOW.findall(whole):
                        depth += (x in "[{") - (x in "]}") if len(x) == 1 else 0
                    if depth <= 0 or i >= len(lines):
                        break
                    whole += "\n" + lines[i]
                    i += 1
                for x in _YAML_FLOW.findall(whole):
                    if not x.strip() or x[0] == "#":
                        continue
                    if x in ("[", "]", "{", "}", ","):
                        out.append(t[x])
                    elif x.rstrip().endswith(":") and len(x) > 1:
                        out.append(key)
                    else:
                        out.append(scalar)
                out.append(nl)
                break
            if body[0] in "\"'":
                q = body[0]
                rx = r'"(?:[^"\\]|\\.)*"' if q == '"' else r"'(?:[^']|'')*'"
                m = re.match(rx, body, re.S)
                j = i
                while not m and j < len(lines):
                    body += "\n" + lines[j]
                    j += 1
                    m = re.match(rx, body, re.S) if q in lines[j - 1] else None
                if not m:
                    out += [ERROR, nl]
                    break
                i = j
                tail = body[m.end() :].strip()
                out += [scalar, nl] if not tail or tail[0] == "#" else [ERROR, nl]
                break
            if body[0] in "@`%" or body[0] in "]},":
                out.append(ERROR)
            elif re.search(r":(?:\s|$)", re.sub(r"\s#.*", "", body)) :
                out.append(ERROR)
            else:
                out.append(scalar)
            out.append(nl)
            break
    while len(stack) > 1:
        stack.pop()
        out.append(ded)
    out.append(EOF)
    return out


class Yaml(Language):
    """Block structure is found line by line, so that the token stream is made from the text."""

    def __init__(self):
        self.dialects = [Grammar(YAML)]

    def accepting(self, text: str) -> int | None:
        toks = yaml_tokens(text, self.dialects[0].terminals)
        return 0 if len(toks) == 1 or ERROR not in toks and self.dialects[0].parse(toks)[0] else None


# ---------------------------------------------------------------- lexers

_OPS_C = r"\.\.\.|<<=|>>=|->|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<|>>|\S"
_OPS_JAVA = r"\.\.\.|<<=|->|::|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<|\S"
_OPS_JS = r"\.\.\.(?!\d)|===|!==|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\?\?|\*\*|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<|\S"
_OPS_GO = r"\.\.\.|&\^=|<<=|>>=|:=|<-|\+\+|--|&&|\|\||&\^|[-+*/%&|^=!<>]=|<<|>>|\S"
_OPS_RUST = r"\.\.=|\.\.\.|\.\.|<<=|->|=>|::|&&|\|\||[-+*/%&|^=!<>]=|<<|\S"
_OPS_PY = r"\.\.\.|\*\*=|//=|>>=|<<=|:=|->|\*\*|//|<<|>>|[-+*/%@&|^=!<>]=|\S"
_REGEX = r"(?:(?<=[(,=:\[!&|?{};+>])|(?<=[(,=:\[!&|?{};+>]\s)|(?<=return\s)|(?<=^))/(?![*/\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_TEMPLATE = r"`(?:[^`\\$]|\\(?s:.)|\$(?!\{)|\$\{(?:[^{}`]|\{(?:[^{}`]|\{[^{}`]*\})*\}|`[^`]*`)*\})*`"
_PYSTR = r"""(?:[rRbBuUfF]{1,3})?(?:\"\"\"(?s:(?:[^\\]|\\.)*?)\"\"\"|'''(?s:(?:[^\\]|\\.)*?)'''|"(?:[^"\\\n]|\\(?s:.))*"|'(?:[^'\\\n]|\\(?s:.))*')"""


def _js_kind(lexeme: str):
    if lexeme[0] == "/" and len(lexeme) > 2 and lexeme[1] not in "/*":
        return "REGEX"
    if lexeme[0] == "#":
        return "PRIVATE" if len(lexeme) > 1 and lexeme[1] != "!" else (SKIP if len(lexeme) > 1 else ERROR)
    return _c_like(lexeme)


def _rust_kind(lexeme: str):
    if lexeme[0] == "'" and (len(lexeme) < 3 or lexeme[-1] != "'"):
        return "LIFE" if len(lexeme) > 1 else ERROR
    if lexeme[0] in "rb" and lexeme[-1] in "\"'#" and len(lexeme) > 1:
        return "STR"
    return _c_like(lexeme)


def _python_kind(lexeme: str):
    c = lexeme[0]
    if c == "#":
        return SKIP
    if c == "\n":
        return NEWLINE
    if c == "\\":
        return SKIP if len(lexeme) > 1 else ERROR
    if lexeme[-1] in "\"'" and len(lexeme) > 1:
        return "STR"
    if c.isalpha() or c == "_":
        return "NAME"
    if c.isdigit() or (c == "." and lexeme[1:2].isdigit()):
        return "NUM" if _PYNUM.fullmatch(lexeme) else ERROR
    return ERROR


_PYNUM = re.compile(r"(?i)0x[\da-f_]+|0b[01_]+|0o[0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:e[+-]?\d[\d_]*)?j?")


def _json_kind(lexeme: str):
    c = lexeme[0]
    if c == '"' and len(lexeme) > 1:
        return "STR" if _JSONSTR.fullmatch(lexeme) else ERROR
    return "NUM" if _JSONNUM.fullmatch(lexeme) else ERROR


_JSONSTR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[\da-fA-F]{4})*"')
_JSONNUM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def _toml_kind(lexeme: str):
    c = lexeme[0]
    if c == "#":
        return SKIP
    if c == "\n":
        return NEWLINE
    if c in "\"'":
        return "STR" if len(lexeme) > 1 else ERROR
    if re.fullmatch(r"[+-]?(?:\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|inf|nan)", lexeme):
        return "NUM"
    if re.fullmatch(r"\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?", lexeme):
        return "DATE"
    return "BARE" if re.fullmatch(r"[\w-]+", lexeme) else ERROR


def _css_kind(lexeme: str):
    c = lexeme[0]
    if lexeme.startswith("/*"):
        return SKIP if len(lexeme) > 3 else ERROR
    if c == "@":
        return "AT" if len(lexeme) > 1 else "@"
    if c == "#":
        return "HASH" if len(lexeme) > 1 else "#"
    if c in "\"'":
        return "STR" if len(lexeme) > 1 else ERROR
    if lexeme[:4].lower() == "url(":
        return "STR"
    if lexeme in ("<!--", "-->"):
        return "CDATA"
    if re.match(r"[+-]?(?:\d|\.\d)", lexeme):
        return "NUM"
    if c.isalpha() or c in "-_\\" or ord(c) > 127:
        return "IDENT"
    return ERROR


def _sql_kind(lexeme: str):
    c = lexeme[0]
    if lexeme.startswith(("--", "/*")):
        return SKIP if lexeme != "/*" else ERROR
    if c in "\"`[" and len(lexeme) > 1:
        return "NAME"
    if c in "'$" and len(lexeme) > 1:
        return "STR" if lexeme[-1] in "'$" else "PARAM"
    if c in "eEnNxXbBrR" and lexeme[-1] == "'":
        return "STR"
    if c.isdigit() or (c == "." and len(lexeme) > 1):
        return "NUM"
    if c.isalpha() or c == "_":
        return "NAME"
    if c in ":?%@$" and len(lexeme) > 1:
        return "PARAM"
    return "PARAM" if c == "?" else ERROR


#: Lexemes that only some systems know; a dialect rejects those of the others.
_SQL_OWN = {
    "postgres": r"::|->>?|\$\w*\$(?s:.*)|~\*|!~|@>|<@|&&|\$\d+",
    "mysql": r"`(?s:.*)`|<=>|@@?\w+|->>?|&&",
    "tsql": r"@@?\w+",
}


def _sql_rejects(name: str):
    """Whether a lexeme belongs to other systems than this one."""
    own, others = re.compile(_SQL_OWN[name]), re.compile("|".join(x for n, x in _SQL_OWN.items() if n != name))
    return lambda lexeme: bool(others.fullmatch(lexeme)) and not own.fullmatch(lexeme)


def _bash_kind(lexeme: str):
    c = lexeme[0]
    if c == "#":
        return SKIP
    if c == "\n":
        return NEWLINE
    if c == "\\" and len(lexeme) > 1 and lexeme[1] == "\n":
        return SKIP
    if lexeme.startswith("<<") and not lexeme.startswith("<<<") and "\n" in lexeme:
        return "HEREDOC"
    if lexeme.startswith("((") and lexeme.endswith("))"):
        return "ARITH"
    if re.match(r"(?:\d*|&)(?:<<<|<>|>\||>>|<|>)", lexeme):
        return "DUP" if re.search(r"&[\d-]+$", lexeme) else "REDIR"
    if lexeme in ("[", "]"):
        return "TEST"
    if lexeme in ('"', "'", "`"):
        return ERROR
    if re.match(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=", lexeme):
        return "ASSIGN"
    return "WORD"


_BW = r"""(?:[^\s"'`$\\<>|&;()#]|(?<=[^\s;|&(])\#|\\(?s:.)|"(?:[^"\\]|\\(?s:.))*"|'[^']*'|`[^`]*`|\$\{[^}]*\}|\$\(\((?s:.*?)\)\)|\$\((?:[^()]|\([^()]*\))*\)|\$(?:'(?:[^'\\]|\\.)*')|\$\w*|\$[@*#?$!-]|(?<==)\((?:[^()]|\([^()]*\))*\)|[<>]\([^()]*\))+"""

_LANGUAGES = {
    "java": lambda: Language(rf"{_CBLOCK}|{_CLINE}|/\*|\"\"\"(?s:.*?)\"\"\"|{_DQ}|{_SQ}|{_ID}|{_NUM}|{_OPS_JAVA}", _c_like, [JAVA]),
    "c": lambda: Language(rf"{_CBLOCK}|{_CLINE}|/\*|^[ \t]*\#(?:[^\n\\]|\\\n|\\.)+|[LuU]?{_DQ}|[LuU]?{_SQ}|{_ID}|{_NUM}|{_OPS_C}", lambda x: "STR" if x[-1] in "\"'" and len(x) > 1 and x[0] in "LuU\"'" else _c_like(x.lstrip()), [C, C_ISO]),
    "javascript": lambda: Language(rf"\n|{_CBLOCK}|{_CLINE}|/\*|\A\#![^\n]*|{_DQ}|{_SQ}|{_TEMPLATE}|{_REGEX}|\#?{_ID}|\$[\w$]*|{_NUM}|{_OPS_JS}", _js_kind, [JAVASCRIPT, JS_SCRIPT], layout=js_layout),
    "typescript": lambda: Language(rf"\n|{_CBLOCK}|{_CLINE}|/\*|\A\#![^\n]*|{_DQ}|{_SQ}|{_TEMPLATE}|{_REGEX}|\#?{_ID}|\$[\w$]*|{_NUM}|{_OPS_JS}", _js_kind, [TYPESCRIPT], layout=js_layout),
    "go": lambda: Language(rf"\n|{_CBLOCK}|{_CLINE}|/\*|{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\.)+'|{_ID}|{_NUM}|{_OPS_GO}", _c_like, [GO], layout=go_layout),
    "rust": lambda: Language(rf"{_CBLOCK}|{_CLINE}|/\*|b?r\#+\"(?s:.*?)\"\#+|b?r?\"(?:[^\"\\]|\\(?s:.))*\"|b?'(?:[^'\\\n]|\\(?:x..|u\{{[^}}]*\}}|.))'|'{_ID}|(?:r\#)?{_ID}|0[xXbBoO][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?\w*|{_OPS_RUST}", _rust_kind, [RUST]),
    "python": lambda: Language(rf"\n[ \t]*|\#[^\n]*|{_PYSTR}|\\\r?\n|[^\W\d]\w*|0[xXbBoO][\da-fA-F_]+\w*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?\w*|{_OPS_PY}", _python_kind, [PYTHON, PYTHON_OLD], layout=python_layout),
    "json": lambda: Language(r'"(?:[^"\\\n]|\\.)*"|[-+\w.]+|\S', _json_kind, [JSON]),
    "toml": lambda: Language(r"\n|#[^\n]*|\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?|[+-]?\d[\d_]*\.\d[\d_]*(?:[eE][+-]?\d+)?|[+-]?[\w-]+|\S", _toml_kind, [TOML], layout=line_layout),
    "yaml": Yaml,
    "css": lambda: Language(r"/\*(?s:.*?)\*/|/\*|<!--|-->|\"(?:[^\"\\\n]|\\(?s:.))*\"|'(?:[^'\\\n]|\\(?s:.))*'|(?i:url)\([^)\"']*\)|@[-\w]+|\#[-\w]+|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:%|[A-Za-z]+)?|-{0,2}[^\W\d][-\w]*|\\.|--|\S", _css_kind, [CSS], layout=css_layout),
    "sql": lambda: Language(r"--[^\n]*|/\*(?s:.*?)\*/|/\*|(?:[eEnNxXbBrR])?'(?:[^'\\]|''|\\(?s:.))*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\$(\w*)\$(?s:.*?)\$\1\$|::|[:@$%]\w+|%\(\w+\)s|[^\W\d][\w$]*|\d[\w.]*(?:[eE][+-]?\d+)?|\.\d+|->>|<=>|->|<>|<=|>=|!=|==|\|\||!~|~\*|@>|<@|&&|<<|>>|\S".replace(r"\$(\w*)\$(?s:.*?)\$\1\$", r"\$\w*\$(?s:.*?)\$\w*\$"), _sql_kind, [SQL, SQL, TSQL], fold=True, rejects=[*map(_sql_rejects, _SQL_OWN)]),
    "bash": lambda: Language(rf"\n|(?:(?<=\s)|(?<=^)|(?<=[;(]))\#[^\n]*|\\\r?\n|<<-?\s*['\"]?(?P<tag>\w+)['\"]?(?s:.*?)\n\s*(?P=tag)(?=\s|$)|(?<![\w)])\(\((?s:.*?)\)\)|\d*(?:<<<|<>|>\||>>&?|>&\d?-?|<&\d?-?|&>>?|<(?!\()|>(?!\())|&&|\|\||;;&|;;|;&|\|&|[;|&]|{_BW}|[()]|\S", _bash_kind, [BASH], layout=line_layout),
}


@lru_cache(maxsize=None)
def language(name: str) -> Language | None:
    """Lexer and grammars of a language; None where every text is valid or none is known."""
    make = _LANGUAGES.get(name)
    return make() if make else None

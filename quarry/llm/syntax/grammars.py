"""Tokens and content grammars of the languages."""

from __future__ import annotations

from quarry.llm.syntax.automata import Grammar

# Languages by file extension.
EXTENSIONS = {
    "python": ("py", "pyi", "pyw"), "rust": ("rs",), "go": ("go",), "java": ("java",), "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx", "c++"), "csharp": ("cs",), "php": ("php", "phtml"),
}

# Reserved words, and words reserved only in places, of each language.
RESERVED = {
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return switch throw try typeof var void while with",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while",
    "java": "abstract assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface native new package private protected public return static strictfp switch synchronized throw throws transient try volatile while",
    "csharp": "abstract as break case catch checked class const continue default delegate do else enum event explicit extern finally fixed for foreach goto if implicit in interface internal is lock namespace new operator out override params private protected public readonly ref return sealed sizeof stackalloc static struct switch throw try typeof unchecked unsafe using virtual volatile while",
    "c": "break case const continue default do else enum extern for goto if inline register restrict return sizeof static struct switch typedef union volatile while",
    "cpp": "break case catch class const constexpr consteval constinit continue default delete do else enum explicit export extern for friend goto if inline mutable namespace new noexcept operator private protected public register return sizeof static static_assert struct switch template throw try typedef typename union using virtual volatile while co_await co_return co_yield decltype",
    "php": "abstract and as break case catch class clone const continue declare default do echo else elseif endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface match namespace new or print private protected public readonly require require_once return static switch throw trait try use var while xor yield",
}
SOFT = {
    "python": "match case type",
    "javascript": "async await from as of get set static let yield",
    "typescript": "async await from as of get set static let yield abstract declare enum implements interface is keyof module namespace private protected public readonly type infer satisfies override asserts unique accessor",
    "rust": "union default macro_rules auto raw",
    "java": "var record sealed permits yield non when super this",
    "csharp": "var async await get set init add remove partial where yield record when and or not required file with select from value global managed scoped on equals by into let orderby join group ascending descending",
    "c": "asm __asm__ __asm __volatile__",
    "cpp": "override final auto requires concept import module asm __asm__ __asm __volatile__",
    "php": "enum from mixed",
}
RESERVED["typescript"] = RESERVED["javascript"]

_JS_COMMON = """
prefix = '!' | '~' | '-' | '+' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | 'yield' '*'? | '...' | assertion
function = 'async'? 'function' '*'? ID? generics? <params> returns? <block>
heritage = ('extends' ID ('.' NAME)* generics? <args>?)? ('implements' typelist)?
class = 'abstract'? 'class' ID? generics? heritage <classbody>
arrow = 'async'? (ID | generics? <params> returns?) '=>'
atom = ID | NUM | STR | <paren> | <array> | <object> | function | class | 'import'
postfix = <args> | <array> | '.' '#'? NAME | '?.' ('#'? NAME | <args> | <array>) | STR | '++' | '--' | typed
operand = (prefix | arrow)* (atom postfix* | arrow <block>)
binary = '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '&&' | '||' | '??' | '<<' | '>' '>' | '>' '>' '>' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'in' | 'instanceof'
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&&=' | '||=' | '??='
chain = (operand assign)* operand (binary operand)*
inner = chain ('?' chain ':' chain)*
expr = chain ('?' inner ':' chain)*
exprs = expr (',' expr)*
pattern = ID | <array> | <object>
binding = pattern definite? annotation? ('=' expr)?
decl = ('const' | 'let' | 'var') binding (',' binding)*
simple = exprs | decl | 'return' exprs? | 'throw' exprs | 'break' ID? | 'continue' ID? | 'debugger' | import | exportlist | typedecl
import = 'import' 'type'? (STR | (ID | <names> | '*' 'as' ID) (',' (<names> | '*' 'as' ID))? 'from' STR) (('with' | ID) <object>)?
exportlist = 'export' 'type'? (<names> ('from' STR)? | '*' ('as' NAME)? 'from' STR) | 'export' (decl | 'default' exprs | typedecl) | 'export' '=' exprs
head = 'if' <paren> | 'else' | 'for' 'await'? <for> | 'while' <paren> | 'do' | 'with' <paren> | ID ':' | 'try' | 'finally' | 'catch' <params>?
decorators = ('@' ID ('.' NAME)* <args>? ';'?)*
stmt = head* (simple ';' | <block> | ';' | decorators ('export' 'default'?)? 'declare'? (function | class | typestmt) | 'switch' <paren> <switch>)
block = stmt* (head* simple)?
paren = exprs
args = (expr (',' expr)* ','?)?
array = (expr? (',' expr?)*)
names = ('type'? (NAME | STR) ('as' (NAME | STR))? (',' 'type'? (NAME | STR) ('as' (NAME | STR))?)* ','?)?
key = '#'? NAME | STR | NUM | <array>
object = (prop (',' prop)* ','?)?
prop = '...' expr | key ':' expr | ID ('=' expr)? | ('async' | 'get' | 'set' | '*')* key generics? <params> returns? <block>
for = (decl | exprs)? ';' exprs? ';' exprs? | (('const' | 'let' | 'var')? pattern | operand) ('of' | 'in') exprs
switch = (('case' exprs | 'default') ':' stmt* )* (('case' exprs | 'default') ':' block)?
file = block
"""

JAVASCRIPT = Grammar(_JS_COMMON + """
assertion = '#never'
generics = '#never'
typed = '#never'
returns = '#never'
annotation = '#never'
definite = '#never'
typelist = '#never'
typedecl = '#never'
typestmt = '#never'
params = (param (',' param)* ','?)?
param = '...'? pattern ('=' expr)?
classbody = member*
member = ';' | decorators ('static' | 'async' | 'get' | 'set' | '*')* key (<params> <block> | ('=' expr)? ';') | 'static' <block>
""")

TYPESCRIPT = Grammar(_JS_COMMON + """
tname = NAME ('.' NAME)* | STR | NUM | '-' NUM | <typebody> | <tuple> | <tparen> | 'void' | 'typeof' ID ('.' NAME)*
tmark = 'keyof' | 'readonly' | 'unique' | 'infer' | 'asserts' | 'typeof' | 'new' | 'abstract'
tatom = (tmark | gen? <params> '=>')* tname gen? (<array>)*
type = '|'? tatom (('|' | '&' | 'extends' | '=>' | 'is') tatom)* ('?' tatom ':' tatom)*
gen = '<' 'const'? type ('=' type)? (',' type ('=' type)?)* ','? '>'
generics = gen
assertion = '<' (type | 'const') '>'
typed = '!' | gen <args> | ('as' | 'satisfies') ('const' | type)
returns = ':' type
annotation = ':' type
definite = '!' | '?'
typelist = type (',' type)*
typedecl = 'declare'? 'type' ID generics? '=' type | 'declare' decl | 'declare' 'function' ID generics? <params> returns? | 'async'? 'function' ID generics? <params> returns?
typestmt = 'interface' ID generics? ('extends' typelist)? <typebody> | 'const'? 'enum' ID <enum> | ('namespace' | 'module') (ID ('.' ID)* | STR) <block> | 'global' <block>
enum = (key ('=' expr)? (',' key ('=' expr)?)* ','?)?
tuple = ('...'? (ID '?'? ':')? type '?'? (',' '...'? (ID '?'? ':')? type '?'?)* ','?)?
tparen = type
modifier = 'public' | 'private' | 'protected' | 'static' | 'async' | 'get' | 'set' | '*' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor'
params = (param (',' param)* ','?)?
param = decorators ('public' | 'private' | 'protected' | 'readonly' | 'override')* '...'? pattern '?'? annotation? ('=' expr)?
classbody = member*
member = ';' | decorators modifier* key ('?' | '!')? (generics? <params> returns? (<block> | ';') | annotation? ('=' expr)? ';') | 'static' <block> | modifier* <index> annotation ';'
typebody_sep = ';' | ','
tmember = ('readonly' | 'get' | 'set' | '+' | '-')* (key '?'? (generics? <params> returns? | annotation)? | generics? <params> returns? | 'new' <params> returns? | <index> ('?' | '+' '?' | '-' '?')? annotation)
index = ID (':' type | 'in' type ('as' type)?)
typebody = (tmember (typebody_sep tmember)* typebody_sep?)?
""")

GO = Grammar("""
tmod = '*' | <len> | 'chan' '<-'? | '<-' 'chan' | 'map' <mapkey> | '...' | <paren>
tname = ID ('.' ID)? <args>? | ID ('.' ID)? <targs> | 'struct' <fields> | 'interface' <methods> | 'func' <params> result? | <paren>
type = (('*' | <len> | 'chan' '<-'? | '<-' 'chan' | 'map' <mapkey>))* (ID ('.' ID)? <targs>? | 'struct' <fields> | 'interface' <methods> | 'func' <params> result? | <tparen>)
result = <params> | type
literal = 'func' <params> result? <block>
typelit = (<len>+ | 'map' <mapkey> | '*' | 'chan' '<-'?)* ('struct' <fields> | 'interface' <methods> | ID ('.' ID)?) | 'map' <mapkey> type | <len>+ type | 'chan' type
prefix = '!' | '-' | '+' | '^' | '*' | '&' | '<-' | '~'
atom = ID | NUM | STR | <paren> | literal | typelit
postfix = '.' (ID | <paren> | <typeassert>) | <args> | <index> | <composite>
operand = prefix* atom postfix*
binary = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&^' | '&&' | '||' | '<<' | '>>' | '==' | '!=' | '<' | '>' | '<=' | '>='
expr = operand (binary operand)*
exprs = expr (',' expr)*
assign = '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
lhs = operand (',' operand)*
varspec = ID (',' ID)* type? ('=' exprs)?
simple = exprs | lhs assign exprs | operand ('++' | '--') | expr '<-' expr
short = simple
nohead = expr
rangehead = (lhs (':=' | '='))? 'range' expr
if = 'if' (simple? ';')? expr <block>
stmt = simple ';' | ';' | <block> ';'? | 'return' exprs? ';' | ('break' | 'continue' | 'goto') ID? ';' | 'fallthrough' ';' | ('go' | 'defer') expr ';' | ID ':' | 'var' (varspec | <vars>) ';' | 'const' (varspec | <vars>) ';' | 'type' (typespec | <types>) ';' | if ('else' if)* ('else' <block>)? ';'
  | 'for' (simple? ';' expr? ';' simple? | expr | rangehead)? <block> ';' | 'switch' (simple? ';')? (simple)? <cases> ';' | 'select' <cases> ';'
last = simple | 'return' exprs? | ('break' | 'continue' | 'goto') ID? | 'fallthrough' | ('go' | 'defer') expr | 'var' varspec | 'const' varspec | 'type' typespec | <block> | if ('else' if)* ('else' <block>)? | 'for' (simple? ';' expr? ';' simple? | expr | rangehead)? <block> | 'switch' (simple? ';')? (simple)? <cases> | 'select' <cases>
block = stmt* last?
typespec = ID <tparams>? '='? type
types = (typespec ';')* typespec?
vars = (varspec ';')* varspec?
import = (ID | '.')? STR
imports = (import ';')* import?
file = ';'* 'package' NAME ';' ('import' (import | <imports>) ';')* (top ';')* top?
top = 'func' <params>? ID <tparams>? <params> result? <block>? | 'var' (varspec | <vars>) | 'const' (varspec | <vars>) | 'type' (typespec | <types>) 
cases = ((('case' (simple | 'type' | type (',' type)*) | 'default') ':') stmt*)* (('case' (simple | type (',' type)*) | 'default') ':' block)?
fields = (field ';')* field?
field = ((ID (',' ID)*) type | '*'? ID ('.' ID)? <targs>?) STR?
methods = (method ';')* method?
method = ID <params> result? | '~'? type ('|' '~'? type)*
params = (param (',' param)* ','?)?
param = ID? '...'? type
paren = exprs ','? | type
tparen = type
args = ((expr | type) (',' (expr | type))* '...'? ','?)?
targs = type (',' type)*
tparams = (ID (',' ID)* ('~'? type ('|' '~'? type)*) (',' ID (',' ID)* ('~'? type ('|' '~'? type)*))* ','?)
index = expr | expr? ':' expr? (':' expr)? | type (',' type)*
len = (expr | '...')?
mapkey = type
typeassert = type | 'type'
composite = (element (',' element)* ','?)?
element = ((expr | <composite>) ':')? (expr | <composite>)
""")

RUST = Grammar("""
life = LIFE
gen = '<' (garg (',' garg)* ','?)? '>'
garg = (ID '=')? type | NUM | <block> | life
tbase = ('&' '&'? life? 'mut'? | '&&' life? 'mut'? | '*' ('const' | 'mut') | 'dyn' | 'impl' | '?' | 'for' '<' (life (',' life)*)? '>')* (('<' type ('as' type)? '>' '::' | '::')? ID ('::'? gen)? ('::' ID ('::'? gen)?)* (<types> ('->' tbase)?)? | <types> | <arrayt> | '!' | life | ('unsafe' | 'extern' STR?)* 'fn' <types> ('->' tbase)?)
type = tbase ('+' tbase)*
tparam = 'const'? (ID | life) (':' type?)? ('=' (type | NUM))?
tparams = '<' (tparam (',' tparam)* ','?)? '>'
where = 'where' (type ':' type (',' type ':' type)* ','?)?
patom = '&'* 'ref'? 'mut'? (ID ('::' ID)* (<pats> | <patfields>)? ('@' pnum)? | <pats> | <slice> | pnum | '..' | '..=' | 'box' ID)
pnum = '-'? (NUM | STR) (('..=' | '..' | '...') ('-'? (NUM | STR))?)? | ID ('::' ID)* ('..=' | '..') (NUM | ID)
pat = '|'? patom ('|' patom)*
closure = 'async'? 'move'? ('||' | '|' (pat (':' type)? (',' pat (':' type)?)*)? '|') ('->' type)?
prefix = '!' | '-' | '*' | '&' 'mut'? | '&&' 'mut'? | '..' | '..=' | closure | 'return' | 'break' life? | 'box' | 'yield'
pathx = ('::')? ID ('::' (ID | gen))* | '<' type ('as' type)? '>' ('::' (ID | gen))+
condition = cond
simpleop = prefix* (pathx ('!' (<args> | <slice>))? | NUM | STR | <paren> | <slice>) postfix*
cond = ('let' pat '=')? simpleop ((binary | assign) ('let' pat '=')? simpleop)*
control = (life ':')? ('if' cond <block> ('else' 'if' cond <block>)* ('else' <block>)? | 'match' cond <arms> | 'loop' <block> | 'while' cond <block> | 'for' pat 'in' cond <block> | ('unsafe' | 'async' 'move'? | 'const')* <block>)
atom = pathx ('!' (<args> | <slice> | <block>) | <struct>)? | NUM | STR | <paren> | <slice> | control
postfix = <args> | <slice> | '.' (ID ('::' gen)? | NUM | 'await') | '?' | 'as' type
operand = prefix* atom postfix* | prefix* ('return' | 'break' life? | 'continue' life? | '..')
binary = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '..' | '..='
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='
expr = (operand assign)* operand (binary operand)* '..'?
attrs = ('#' '!'? <attr>)*
vis = ('pub' <args>?)?
use = 'use' usepath
usepath = '::'? ((ID | 'as') ('::' (ID | 'as'))* ('::' ('*' | <uses>))? | '*' | <uses>) ('as' ID)?
fn = ('default' | 'const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' ID tparams? <params> ('->' type)? where?
item = vis (use ';' | fn (<block> | ';') | 'struct' ID tparams? where? (<fields> | <tuplefields> where? ';' | ';') | 'union' ID tparams? where? <fields> | 'enum' ID tparams? where? <variants> | 'default'? 'unsafe'? 'impl' tparams? '!'? type ('for' type)? where? <items> | 'unsafe'? 'auto'? 'trait' ID tparams? (':' type?)? where? <items> | 'mod' ID (<items> | ';') | 'unsafe'? 'extern' STR? <items> | 'extern' ID ID ('as' ID)? ';' | ('const' | 'static') 'mut'? ID (':' type)? ('=' expr)? ';' | 'type' ID tparams? (':' type)? where? ('=' type where?)? ';' | 'macro_rules' '!' ID (<any> | <anyp> ';') | pathx '!' (<block> | <any> | <args> ';' | <slice> ';'))
items = (attrs item | ';')* 
file = (attrs item | ';')*
let = 'let' pat (':' type)? ('=' expr ('else' <block>)?)?
stmt = attrs (let ';' | item | expr ';' | control | ';' | pathx '!' (<block> | <any>))
block = stmt* attrs expr?
params = (attrs param (',' attrs param)* ','?)?
param = '&' life? 'mut'? ID | 'mut'? ID | pat ':' type | '...'
args = (expr (',' expr)* ','?)? | 'in'? ID ('::' ID)*
paren = (expr (',' expr)* ','?)?
slice = (expr ((',' expr)* ','? | ';' expr))?
types = (type (',' type)* ','?)? | (ID ':' type (',' ID ':' type)* ','?)
arrayt = type (';' expr)?
pats = (pat (',' pat)* ','?)?
patfields = (attrs patfield (',' attrs patfield)* ','?)?
patfield = '..' | 'ref'? 'mut'? ID (':' pat)? | NUM ':' pat
struct = ((attrs (ID | NUM) (':' expr)?) (',' attrs (ID | NUM) (':' expr)?)* (',' '..' expr)? ','?)? | '..' expr
fields = (attrs vis ID ':' type (',' attrs vis ID ':' type)* ','?)?
tuplefields = (attrs vis type (',' attrs vis type)* ','?)?
variants = (attrs variant (',' attrs variant)* ','?)?
variant = ID (<fields> | <tuplefields>)? ('=' expr)?
arm = attrs pat ('if' expr)? '=>'
arms = (arm (expr ',' | <block> ','? | control ','?))* (arm expr)?
attr = ANY*
any = ANY*
anyp = ANY*
uses = (usepath (',' usepath)* ','?)?
""")

JAVA = Grammar("""
ann = ('@' ID ('.' ID)* <args>?)*
dims = (ann <empty>)*
g = '<' (targ (',' targ)*)? '>'
targ = ann '?' (('extends' | 'super') type)? | type
type = ann ID g? ('.' ann ID g?)* dims
tparams = '<' ann ID ('extends' type ('&' type)*)? (',' ann ID ('extends' type ('&' type)*)?)* '>'
prefix = '!' | '~' | '-' | '+' | '++' | '--' | <cast> | (ID | <lambda>) '->'
creation = 'new' ann g? ID g? ('.' ID g?)* ((<args> <classbody>?) | (<index> | <empty>)+ <list>?)
atom = ID | NUM | STR | <paren> | creation | 'class' | 'switch' <paren> <switch> | <list>
postfix = <args> | <index> | '.' (g? ID | creation | 'class') | '++' | '--' | g? '::' (ID | 'new') | g '.' ID | <empty> ('.' 'class' | '::' 'new')
operand = prefix* (atom postfix* | (ID | <lambda>) '->' <block>)
binary = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '<<' | '>' '>' | '>' '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>='
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
test = 'instanceof' 'final'? type (ID | <args> ID?)?
chain = (operand assign)* operand test? (binary operand test?)*
inner = chain ('?' chain ':' chain)*
expr = chain ('?' inner ':' chain)*
declarator = ID dims ('=' expr)?
local = ann 'final'? ann type declarator (',' declarator)*
mods = (ann ('public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'))* ann
simple = expr | local | 'return' expr? | 'throw' expr | 'break' ID? | 'continue' ID? | 'yield' expr | 'assert' expr (':' expr)?
head = 'if' <paren> | 'else' | 'for' <for> | 'while' <paren> | 'do' | ID ':' | 'try' <res>? | 'finally' | 'catch' <catch> | 'synchronized' <paren>
typedecl = mods ('class' ID tparams? ('extends' type)? ('implements' type (',' type)*)? ('permits' type (',' type)*)? <classbody> | 'interface' ID tparams? ('extends' type (',' type)*)? ('permits' type (',' type)*)? <classbody> | 'enum' ID ('implements' type (',' type)*)? <enum> | 'record' ID tparams? <params> ('implements' type (',' type)*)? <classbody> | '@' 'interface' ID <classbody>)
stmt = head* (simple ';' | <block> | ';' | typedecl | 'switch' <paren> <switch>)
block = stmt*
member = ';' | typedecl | 'static'? <block> | mods tparams? ann (type declarator (',' declarator)* ';' | (type ID | ID) <params> dims ('throws' type (',' type)*)? (<block> | ';' | 'default' expr ';') | ID <block>)
classbody = member*
enum = (ann ID <args>? <classbody>? (',' ann ID <args>? <classbody>?)* ','?)? (';' member*)?
file = ';'* (ann 'package' NAME ('.' NAME)* ';')? ('import' 'static'? NAME ('.' NAME)* ('.' '*')? ';' | ';')* (typedecl | ';')*
params = (param (',' param)*)?
param = ann 'final'? ann type ann '...'? ann ID dims | ann type 'this'
lambda = (ID (',' ID)* | param (',' param)*)?
args = (expr (',' expr)*)? | (ID '=' (expr | ann) (',' ID '=' expr)*)?
paren = expr
index = expr
empty = 
list = ((expr | ann) (',' (expr | ann))* ','?)?
cast = type ('&' type)*
for = (local | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? | ann 'final'? ann type ID dims ':' expr
res = (local | expr) (';' (local | expr))* ';'?
catch = ann 'final'? type ('|' type)* ID
case = ('case' (expr | type ID | 'default' | type <args>) (',' (expr | 'default'))* ('when' expr)? | 'default')
switch = (case ':' stmt* | case '->' (expr ';' | <block> | 'throw' expr ';'))*
""")

CSHARP = Grammar("""
attrs = (<attr>)*
g = '<' (type? (',' type?)*) '>'
type = ('ref' 'readonly'?)? (('global' '::')? ID g? ('.' ID g?)* ('?' | '*' | <rank>)* | <tuple> ('?' | <rank>)*)
tparams = '<' attrs ('in' | 'out')? ID (',' attrs ('in' | 'out')? ID)* '>'
where = ('where' ID ':' (type | 'class' '?'? | 'struct' | 'new' <args> | ID) (',' (type | 'class' '?'? | 'struct' | 'new' <args>))*)*
prefix = '!' | '~' | '-' | '+' | '++' | '--' | '&' | '*' | '^' | '..' | 'await' | <cast> | 'ref' | 'out' | 'throw' | ('async' | 'static')* (ID | <lambda>) '=>'
creation = 'new' (type? (<args> <init>? | <init>) | type? (<index> | <rank>)+ <init>? | type)
atom = ID | NUM | STR | <paren> | creation | 'typeof' <args> | 'sizeof' <args> | 'default' <args>? | 'checked' <paren> | 'unchecked' <paren> | <init> | <index> | 'stackalloc' type <index>? <init>? | ('async' | 'static')* 'delegate' <params>? <block>
postfix = <args> | <index> | '.' ID g? | '?' '.' ID g? | '?.' ID g? | '?' <index> | '::' ID | '->' ID | '++' | '--' | '!' | g (<args> | '.' ID) | 'switch' <arms> | 'with' <init>
operand = prefix* (atom postfix* | ('async' | 'static')* (ID | <lambda>) '=>' <block>)
declared = type ID
binary = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '??' | '<<' | '>' '>' | '>' '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '..'
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '??='
patt = ('not' | '<' | '>' | '<=' | '>=')* (type? (<args> | <init>)? ID? | NUM | STR | '-' NUM | <index>)
test = 'is' patt (('and' | 'or') patt)* | 'as' type
chain = (operand assign)* operand test* (binary operand test*)*
inner = chain ('?' chain ':' chain)*
query = 'from' type? ID 'in' chain (('from' ID 'in' chain) | 'where' chain | 'let' ID '=' chain | 'orderby' chain ('ascending' | 'descending')? (',' chain)* | 'join' ID 'in' chain 'on' chain 'equals' chain ('into' ID)? | 'select' chain | 'group' chain 'by' chain ('into' ID)?)+
expr = chain ('?' inner ':' chain)* | query
declarator = ID ('=' expr)?
local = ('const' | 'static' | 'using' | 'await' 'using' | 'scoped')* type declarator (',' declarator)*
mods = (attrs ('public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'const' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'async' | 'partial' | 'required' | 'file' | 'ref' | 'event' | 'fixed'))* attrs
simple = expr | local | 'return' expr? | 'throw' expr? | 'break' | 'continue' | 'goto' (ID | 'case' expr | 'default') | 'yield' ('return' expr | 'break')
head = 'if' <paren> | 'else' | 'for' <for> | 'await'? 'foreach' <foreach> | 'while' <paren> | 'do' | ID ':' | 'try' | 'finally' | 'catch' <catch>? ('when' <paren>)? | 'lock' <paren> | 'await'? 'using' <res> | 'fixed' <res> | 'checked' | 'unchecked' | 'unsafe'
localfn = attrs ('static' | 'async' | 'unsafe' | 'extern')* type ID tparams? <params> where (<block> | '=>' expr ';')
stmt = head* (simple ';' | <block> | ';' | 'switch' <paren> <switch> | localfn)
block = stmt*
bases = (':' type <args>? (',' type)*)?
typedecl = mods (('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) ID tparams? <params>? bases where (<classbody> | ';') ';'? | 'enum' ID (':' type)? <enum> ';'? | 'delegate' type ID tparams? <params> where ';')
body = <block> | ';' | '=>' expr ';'
member = typedecl | mods (type declarator (',' declarator)* ';' | type (ID | ID g? '.' ID | 'this' <params>) (<accessors> ('=' expr ';')? | '=>' expr ';') | type (ID g? '.')* ID tparams? <params> where body | '~'? ID <params> (':' ID <args>)? body | type 'operator' OPERATOR <params> body | ('implicit' | 'explicit') 'operator' type <params> body) | ';'
classbody = member*
enum = (attrs ID ('=' expr)? (',' attrs ID ('=' expr)?)* ','?)?
accessors = (mods ('get' | 'set' | 'init' | 'add' | 'remove') body)*
using = 'global'? 'using' 'static'? 'unsafe'? (ID '=')? type ';'
items = ('extern' ID ID ';')* using* (attrs 'namespace' ID ('.' ID)* (<items> ';'? | ';' using*) | typedecl | ';' | <attr>)*
file = ('extern' ID ID ';')* using* (attrs 'namespace' ID ('.' ID)* (<items> ';'? | ';' using*) | typedecl | ';' | <attr>)* | using* stmt+ typedecl*
params = (param (',' param)*)?
param = attrs ('this' | 'ref' 'readonly'? | 'out' | 'in' | 'params' | 'scoped')* type ID ('=' expr)?
lambda = (ID (',' ID)* | param (',' param)*)?
args = ((ID ':')? (expr | 'out' type ID | 'in' expr) (',' (ID ':')? (expr | 'out' type ID | 'in' expr))*)?
paren = expr (',' expr)* | type ID (',' type ID)* | ID ':' expr (',' ID ':' expr)*
index = ((ID ':')? expr (',' (ID ':')? expr)* ','?)?
rank = ','*
init = ((expr | <index> '=' expr) (',' (expr | <index> '=' expr))* ','?)? | ID ':' patt (',' ID ':' patt)*
cast = type
tuple = type ID? (',' type ID?)+
for = (local | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)?
foreach = ('ref' 'readonly'?)? (type ID | type <tuple> | <paren>) 'in' expr | 'var' <paren> 'in' expr
res = local | expr
catch = type ID?
case = ('case' (expr | patt (('and' | 'or') patt)*) ('when' expr)? | 'default') ':'
switch = (case+ stmt+)*
arms = ((patt (('and' | 'or') patt)* ('when' expr)? '=>' expr (',' patt (('and' | 'or') patt)* ('when' expr)? '=>' expr)* ','?))?
attr = (ID ':')? ID ('.' ID)* g? <args>? (',' ID ('.' ID)* g? <args>?)* ','?
""")

_C_COMMON = """
qual = 'const' | 'volatile' | 'restrict' | 'static' | 'extern' | 'inline' | 'register' | 'mutable' | 'constexpr' | 'consteval' | 'constinit' | 'virtual' | 'explicit' | 'friend' | 'typedef' | 'typename' | 'auto'
stars = ('*' | '&' | '&&' | 'const' | 'volatile' | 'restrict' | ID '::' '*')*
basetype = qual* (('struct' | 'union' | 'enum' | 'class') attr ID? (<structbody> | <enum> | ':' ID <enum>)? | name+ | 'decltype' <args>) qual*
prefix = '!' | '~' | '-' | '+' | '++' | '--' | '*' | '&' | '&&' | <cast> | 'sizeof' '...'? | 'co_await' | 'delete' <empty>? | 'throw' | 'co_yield'
postfix = <args> | <index> | '.' '*'? ('template')? NAME tmpl? | '->' '*'? ('template')? NAME tmpl? | '++' | '--' | <init> | '...'
operand = prefix* (atom postfix* | 'throw')
binary = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<=>'
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='
chain = (operand assign)* operand (binary operand)*
inner = chain ('?' chain ':' chain)*
expr = (chain ('?' inner ':' chain)* | <init>)
exprs = expr (',' expr)*
dname = stars (ID ('::' ID tmpl?)* tmpl? | <dparen> | 'operator' OPERATOR | ID '::' '~' ID | <index>) (<index> | <empty> | <params>)*
declarator = dname (':' expr)? marks ('=' expr | <init> | <args>)?
simple = exprs | basetype declarator (',' declarator)* | basetype | 'return' exprs? | 'co_return' exprs? | 'break' | 'continue' | 'goto' '*'? ID | usingdecl | asm
head = 'if' 'constexpr'? <paren> | 'else' | 'for' <for> | 'while' <paren> | 'do' | ID ':' | 'case' expr ('...' expr)? ':' | 'default' ':' | 'switch' <paren> | 'try' | 'catch' <params>
stmt = head* (attr simple ';' | <block> | ';')
block = stmt* head*
paren = exprs | basetype declarator (';' exprs)? | simple ';' exprs
args = ((expr | basetype stars <params>?) (',' (expr | basetype stars <params>?))*)?
index = exprs?
empty = 
cast = basetype stars (<params>)? (<empty> | <index>)*
init = ((desig* expr) (',' desig* expr)* ','?)?
desig = '.' ID '='? | <index> '='? | ID ':'
enum = (attr ID attr ('=' expr)? (',' attr ID attr ('=' expr)?)* ','?)?
dparen = stars ID? (<index> | <empty> | <params>)* | ID '::' '*' ID?
params = (param (',' param)* (',' '...')?)? | '...'
param = attr 'this'? basetype stars '...'? (ID | <dparen>)? (<index> | <empty> | <params>)* ('=' expr)?
for = (basetype declarator (',' declarator)* | exprs)? ';' (exprs | basetype declarator)? ';' exprs? | (simple ';')? basetype stars (ID | <index>) ':' expr
"""

C = Grammar(_C_COMMON + """
name = ID
marks = (ID <attrargs>)*
asm = ('asm' | '__asm__' | '__asm') ('volatile' | '__volatile__' | 'goto' | 'inline')* <asmargs>
asmargs = ANY*
tmpl = '#never'
attr = (ID <attrargs>)?
attrargs = <paren>
atom = ID | NUM | STR+ | <paren> | <cast> <init>
usingdecl = '#never'
structbody = (basetype (declarator (',' declarator)*)? ';' | ';')*
top = basetype declarator (',' declarator)* ';' | basetype ';' | basetype? dname marks (basetype declarator ';')* <block> | ';' | ID <args> ';'? | asm ';'
file = (top | 'extern' STR (<externc> | top))*
externc = top*
""")

CPP = Grammar(_C_COMMON + """
ta = ('const' | 'typename' | 'volatile')* ('::'? ID tmpl? ('::' 'template'? ID tmpl?)* | 'decltype' <args>) 'const'? stars (<params> | <dparen>)* (<index> | <empty>)* '...'? | '-'? NUM | STR | <paren> | '!' ID
tmpl = '<' (ta (',' ta)*)? '>'
name = '::'? ID tmpl? ('::' 'template'? ID tmpl?)*
attr = (<attrs>)*
attrs = ANY*
marks = (ID <args>)*
asm = ('asm' | '__asm__' | '__asm') ('volatile' | '__volatile__' | 'goto' | 'inline')* <asmargs>
asmargs = ANY*
fold = expr binary '...' (binary expr)? | '...' binary expr
requirements = (exprs ';' | 'typename' name ';' | <init> 'noexcept'? ('->' basetype stars)? ';' | 'requires' exprs ';' | ';')*
capture = (('&' | '=' | '*'? ID | '&' ID | '...') '...'? ('=' expr | <init>)? (',' ('=' | '*'? ID | '&' ID | '...') '...'? ('=' expr | <init>)?)*)?
lambda = <capture> (<params> ('mutable' | 'constexpr' | 'noexcept')* ('->' basetype stars)?)? <block>
atom = <fold> | '::'? ID tmpl? ('::' (ID tmpl? | '~' ID | 'operator' OPERATOR))* | NUM | STR+ | <paren> | lambda | 'new' <args>? (basetype stars | <cast>) (<args> | <init> | <index>)* | 'decltype' <args> | 'typename' name | 'noexcept' <args> | 'requires' <params>? <requirements>
usingdecl = 'using' ('namespace'? name | ID '=' basetype stars | 'typename' name | 'enum' name) | 'static_assert' <args>
template = ('template' '<' (tparam (',' tparam)*)? '>' ('requires' exprs)?)*
tparam = ('typename' | 'class') '...'? ID? ('=' basetype stars)? | basetype stars ID? ('=' expr)? | 'template' '<' (('typename' | 'class') ID? (',' ('typename' | 'class') ID?)*)? '>' ('typename' | 'class') ID?
tail = ('const' | 'noexcept' <args>? | 'override' | 'final' | '&' | '&&' | 'volatile' | '->' basetype stars)*
function = basetype? (dname | '~' ID <params> | 'operator' basetype stars <params>) tail (':' name (<args> | <init>) (',' name (<args> | <init>))*)? ('try')? (<block> | ';' | '=' ('default' | 'delete' | NUM) ';')
bases = ':' ('public' | 'private' | 'protected' | 'virtual')* name (',' ('public' | 'private' | 'protected' | 'virtual')* name)*
classdef = qual* ('class' | 'struct' | 'union') attr name 'final'? bases? <structbody> (declarator (',' declarator)*)? ';'
member = ('public' | 'private' | 'protected' | ID) ':' | attr template qual* (classdef | 'enum' ('class' | 'struct')? ID? (':' basetype)? <enum>? declarator? ';' | function | basetype (declarator (',' declarator)*)? ';' | usingdecl ';' | qual* function) | ';'
structbody = member*
top = attr template (classdef | 'enum' ('class' | 'struct')? ID? (':' basetype)? <enum>? declarator? ';' | function | basetype (declarator (',' declarator)*)? ';' | usingdecl ';' | 'inline'? 'namespace' name? ('=' name ';' | <items>)? | 'extern' STR (<items>) | 'extern' 'template' basetype ';' | 'concept' ID '=' exprs ';') | ';' | ID <args> ';'?
items = top*
file = top*
""")

PHP = Grammar("""
name = '\\'? ID ('\\' ID)*
ptype = '?'? (name | 'static' | <type>) (('|' | '&') (name | 'static' | <type>))*
prefix = '!' | '~' | '-' | '+' | '++' | '--' | '&' | '@' | 'new' | 'clone' | 'print' | 'yield' 'from'? | 'throw' | 'include' | 'include_once' | 'require' | 'require_once' | <cast> | '...' | 'static'? 'fn' '&'? <params> (':' ptype)? '=>'
closure = <attrs>? 'static'? 'function' '&'? <params> ('use' <uses>)? (':' ptype)? <block>
atom = VAR | '$'+ (VAR | <braced>) | NUM | STR | name | 'static' | <paren> | <array> | closure | 'match' <paren> <arms> | 'class' <args>? ('extends' name)? ('implements' name (',' name)*)? <classbody> | 'yield'
postfix = <args> | <array> | <braced> | ('->' | '?->') (NAME | VAR | <braced>) | '::' (NAME | VAR | 'class' | <braced>) | '++' | '--'
operand = prefix* atom postfix*
binary = '+' | '-' | '*' | '/' | '%' | '**' | '.' | '&' | '|' | '^' | '&&' | '||' | '??' | '<<' | '>' '>' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<=>' | '<>' | 'and' | 'or' | 'xor' | 'instanceof'
assign = '=' '&'? | '+=' | '-=' | '*=' | '/=' | '.=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '??='
chain = (operand assign)* operand (binary (operand assign)* operand)*
inner = chain ('?' chain? ':' chain)*
expr = chain ('?' inner? ':' chain)*
exprs = expr (',' expr)*
simple = expr | 'echo' exprs | 'return' expr? | 'break' NUM? | 'continue' NUM? | 'global' VAR (',' VAR)* | 'static' VAR ('=' expr)? (',' VAR ('=' expr)?)* | 'const' ID '=' expr (',' ID '=' expr)* | 'goto' ID | 'declare' <args> | 'use' ('function' | 'const')? name ('\\' <names>)? ('as' ID)? (',' name ('as' ID)?)* | 'namespace' name
head = 'if' <paren> | 'elseif' <paren> | 'else' | 'for' <for> | 'foreach' <foreach> | 'while' <paren> | 'do' | 'try' | 'finally' | 'catch' <catch> | ID ':' | 'declare' <args>
alt = ('if' <paren> | 'elseif' <paren> | 'else' | 'for' <for> | 'foreach' <foreach> | 'while' <paren> | 'switch' <paren>) ':' | ('endif' | 'endfor' | 'endforeach' | 'endwhile' | 'endswitch') ';'
fndecl = <attrs>? 'function' '&'? ID <params> (':' ptype)? <block>
classdecl = <attrs>? ('abstract' | 'final' | 'readonly')* ('class' | 'interface' | 'trait' | 'enum') ID (':' ptype)? ('extends' name (',' name)*)? ('implements' name (',' name)*)? <classbody>
stmt = head* (simple ';' | <block> | ';' | 'switch' <paren> <switch> | fndecl | classdecl | HTML) | alt | 'namespace' name? <block>
block = stmt*
file = HTML? (stmt | HTML)* simple?
switch = (('case' expr | 'default') (':' | ';') stmt*)*
paren = expr
args = ((ID ':')? expr (',' (ID ':')? expr)* ','?)? | '...'
array = ((expr ('=>' expr)?)? (',' (expr ('=>' expr)?)?)*)
braced = expr?
type = ptype
cast = ID
params = (param (',' param)* ','?)?
param = <attrs>? ('public' | 'private' | 'protected' | 'readonly')* ptype? '&'? '...'? VAR ('=' expr)?
uses = '&'? VAR (',' '&'? VAR)* ','?
for = exprs? ';' exprs? ';' exprs?
foreach = expr 'as' ('&'? operand '=>')? '&'? operand
catch = name ('|' name)* VAR?
arms = ((exprs | 'default') ','? '=>' expr (',' (exprs | 'default') ','? '=>' expr)* ','?)?
names = ('function' | 'const')? name ('as' ID)? (',' ('function' | 'const')? name ('as' ID)?)* ','?
mods = ('public' | 'private' | 'protected' | 'static' | 'abstract' | 'final' | 'readonly' | 'var')*
member = <attrs>? mods ('function' '&'? NAME <params> (':' ptype)? (<block> | ';') | 'const' ptype? NAME '=' expr (',' NAME '=' expr)* ';' | ptype? VAR ('=' expr)? (',' VAR ('=' expr)?)* ';' | 'use' name (',' name)* (';' | <any>) | 'case' NAME ('=' expr)? ';')
classbody = member*
any = ANY*
attrs = ANY*
""")

PYTHON = Grammar("""
lambda = 'lambda' (lparam (',' lparam)* ','?)? ':'
lparam = ('*' | '**')? ID ('=' ternary0)? | '*' | '/'
atom = ID | NUM | STR+ | <paren> | <list> | <dict> | '...'
postfix = <args> | <index> | '.' ID
operand0 = ('-' | '+' | '~' | 'await' | 'not')* atom postfix*
binary = '+' | '-' | '*' | '/' | '//' | '%' | '**' | '@' | '&' | '|' | '^' | '<<' | '>>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' 'not'? | 'and' | 'or'
chain0 = operand0 (binary operand0)*
ternary0 = chain0 ('if' chain0 'else' chain0)*
operand = (lambda | '-' | '+' | '~' | 'await' | 'not')* atom postfix*
chain = operand (binary operand)*
expr = chain ('if' chain 'else' chain)*
named = (ID ':=')? expr
star = '*'? named
stars = star (',' star)* ','?
target = '*'? atom postfix*
targets = target (',' target)* ','?
comp = ('async'? 'for' targets 'in' chain ('if' named)*)+
yield = 'yield' ('from' expr | stars)?
value = stars | yield
simple = targets (':' expr ('=' value)? | ('+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '**=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=') value | ('=' targets)* '=' value) | value | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') ID (',' ID)* | 'del' targets | 'assert' expr (',' expr)? | 'import' module ('as' ID)? (',' module ('as' ID)?)* | 'from' ('.' | '...')* module? 'import' ('*' | ID ('as' ID)? (',' ID ('as' ID)?)* | <names>) | 'type' ID <args>? '=' expr
module = ID ('.' ID)*
line = simple (';' simple)* ';'? NL
body = (line | NL <suite>)
with = expr ('as' target)? (',' expr ('as' target)?)*
try = 'try' ':' body (('except' ('*'? stars ('as' ID)?)? ':' body)+ ('else' ':' body)? ('finally' ':' body)? | 'finally' ':' body)
decorator = ('@' named NL)*
compound = 'if' named ':' body ('elif' named ':' body)* ('else' ':' body)? | 'while' named ':' body ('else' ':' body)? | 'async'? 'for' targets 'in' stars ':' body ('else' ':' body)? | try | 'async'? 'with' (with | <withs>) ':' body | decorator ('class' ID <tparams>? <args>? ':' body | 'async'? 'def' ID <tparams>? <params> ('->' expr)? ':' body) | 'match' stars ':' NL <cases>
stmt = line | compound
suite = stmt+
file = (stmt | NL)*
cases = ('case' pattern ('if' named)? ':' body)+
patom = ('-')? NUM | STR+ | ID ('.' ID)* (<args>)? | <paren> | <list> | <dict> | '*' ID
pattern = patom ('|' patom)* ('as' ID)? (',' (patom ('|' patom)* ('as' ID)?)?)*
paren = (stars | star comp | yield)?
list = (stars | star comp)?
dict = (stars | star comp | ((expr ':' expr) | '**' expr) (',' ((expr ':' expr) | '**' expr))* ','? | expr ':' expr comp)?
arg = '*' expr | '**' expr | ID '=' expr | named comp?
args = (arg (',' arg)* ','?)?
slice = expr? ':' expr? (':' expr?)? | star
index = slice (',' slice)* ','?
param = ('*' | '**')? ID (':' '*'? expr)? ('=' expr)? | '*' | '/'
params = (param (',' param)* ','?)?
names = ID ('as' ID)? (',' ID ('as' ID)?)* ','?
withs = expr ('as' target)? (',' expr ('as' target)?)* ','?
tparams = ('*' | '**')? ID (':' expr)? ('=' expr)? (',' ('*' | '**')? ID (':' expr)? ('=' expr)?)* ','?
""")

# A reserved word as the name of a package or module is taken for a name, not for damage: the clause is whole.
#: The tokens a repair may insert or put in another's place: names, separators, what a rule cannot do without.
_INSERTABLE = {
    "javascript": "ID ; ,", "typescript": "ID ; ,", "go": "ID ; , package", "rust": "ID ; ,", "java": "ID ; ,",
    "csharp": "ID ; ,", "c": "ID ; ,", "cpp": "ID ; ,", "php": "ID VAR ; ,", "python": "ID NL , :",
}
GRAMMARS = {"javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "go": GO, "rust": RUST, "java": JAVA, "csharp": CSHARP, "c": C, "cpp": CPP, "php": PHP, "python": PYTHON}
for _language, _terminals in _INSERTABLE.items():
    GRAMMARS[_language].insertable = _terminals.split()

#: The kinds a bracket pair's content is tried for, by opening bracket.
KINDS = {
    "javascript": {"(": "paren args params for", "[": "array", "{": "block object classbody names switch"},
    "typescript": {"(": "paren args params for tparen", "[": "array tuple index", "{": "block object classbody names switch typebody enum"},
    "go": {"(": "paren args params imports vars types tparen typeassert", "[": "index len mapkey targs tparams args", "{": "block composite cases fields methods"},
    "rust": {"(": "args paren params types pats tuplefields anyp", "[": "slice arrayt attr any", "{": "block struct patfields fields variants arms items uses any"},
    "java": {"(": "args paren params lambda cast for res catch", "[": "index empty", "{": "block classbody enum list switch"},
    "csharp": {"(": "args paren params lambda cast tuple for foreach res catch", "[": "index rank attr params", "{": "block classbody enum accessors init switch arms items"},
    "c": {"(": "paren args cast params dparen for attrargs asmargs", "[": "index empty", "{": "block init structbody enum externc"},
    "cpp": {"(": "paren args cast params dparen for fold asmargs", "[": "index empty attrs capture", "{": "block init structbody enum items requirements"},
    "php": {"(": "paren args params uses for foreach catch cast array type", "[": "array attrs", "{": "block classbody switch arms braced names any"},
    "python": {"(": "paren args params names withs", "[": "list index tparams args", "{": "dict", "INDENT": "suite cases"},
}

"""Grammars of the five languages, over the token classes of `functions.lexing`.

They accept every sound file of the language and a little more where precedence, names or types would decide.
"""

from __future__ import annotations

import re
from functools import lru_cache

from graphmill.llm.derivatives import Grammar

PYTHON = """
file = ( 'NL' | stmt )*
stmt = simple 'NL' | simple ';' 'NL' | compound
simple = small ( ';' small )*
small = exprs ( ':' expr ( '=' rhs )? | ( '=' rhs )+ | augop rhs )? | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' ( expr ( 'from' expr )? )? | 'global' names | 'nonlocal' names | 'del' exprs | 'assert' expr ( ',' expr )? | 'import' dotted_as ( ',' dotted_as )* | 'from' ( '.' | '...' )* dotted 'import' import_names | 'from' ( '.' | '...' )+ 'import' import_names | 'type' ident typeparams? '=' expr
rhs = exprs | yieldexpr
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
names = ident ( ',' ident )*
dotted = ident ( '.' ident )*
dotted_as = dotted ( 'as' ident )?
import_names = '*' | name_as ( ',' name_as )* | '(' name_as ( ',' name_as )* ','? ')'
name_as = ident ( 'as' ident )?
ident = 'ID' | 'match' | 'case' | 'type'
block = simple ';'? 'NL' | 'NL' 'INDENT' stmt+ 'DEDENT'
compound = 'if' named ':' block ( 'elif' named ':' block )* ( 'else' ':' block )? | 'while' named ':' block ( 'else' ':' block )? | 'async'? 'for' targets 'in' exprs ':' block ( 'else' ':' block )? | 'try' ':' block ( ( 'except' '*'? ( exprs ( 'as' ident )? )? ':' block )+ ( 'else' ':' block )? ( 'finally' ':' block )? | 'finally' ':' block ) | 'async'? 'with' withitems ':' block | decorator* ( 'async'? 'def' ident typeparams? '(' params? ')' ( '->' expr )? ':' block | 'class' ident typeparams? ( '(' args? ')' )? ':' block ) | 'match' exprs ':' 'NL' 'INDENT' ( 'case' patterns ( 'if' named )? ':' block )+ 'DEDENT'
decorator = '@' named 'NL'
withitems = withitem ( ',' withitem )* | '(' withitem ( ',' withitem )* ','? ')'
withitem = expr ( 'as' starred_or )?
typeparams = '[' typeparam ( ',' typeparam )* ','? ']'
typeparam = ( '*' | '**' )? ident ( ':' expr )? ( '=' expr )?
params = param ( ',' param )* ','?
param = ident ( ':' expr )? ( '=' expr )? | '*' ( ident ( ':' starred_or )? )? | '**' ident ( ':' expr )? | '/'
args = arg ( ',' arg )* ','?
arg = named compfor? | ident '=' expr | '*' expr | '**' expr
targets = target ( ',' target )* ','?
target = '*'? primary
patterns = pattern ( ',' pattern )* ','?
pattern = '*' ident | orpattern ( 'as' ident )?
orpattern = patom ( '|' patom )*
patom = '-'? 'NUM' ( ( '+' | '-' ) 'NUM' )? | 'STR'+ | 'None' | 'True' | 'False' | dotted ( '(' ( pargs )? ')' )? | '(' patterns? ')' | '[' patterns? ']' | '{' ( pkv ( ',' pkv )* ','? )? '}'
pargs = parg ( ',' parg )* ','?
parg = pattern | ident '=' pattern
pkv = patom ':' pattern | '**' ident
exprs = starred_or ( ',' starred_or )* ','? | yieldexpr
starred_or = '*' expr | named
named = expr ( ':=' expr )?
yieldexpr = 'yield' ( 'from' expr | exprs )?
expr = lambda | orx ( 'if' orx 'else' expr )?
lambda = 'lambda' lparams? ':' expr
lparams = lparam ( ',' lparam )* ','?
lparam = ident ( '=' expr )? | '*' ident? | '**' ident | '/'
orx = 'not'* cmp ( ( 'and' | 'or' ) 'not'* cmp )*
cmp = arith ( ( '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? ) arith )*
arith = unary ( binop unary )*
binop = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '>>' | '<<' | '**'
unary = ( '+' | '-' | '~' )* 'await'? primary
primary = atom trailer*
trailer = '.' ident | '(' args? ')' | '[' subs ']'
subs = sub ( ',' sub )* ','?
sub = named | '*' expr | expr? ':' expr? ( ':' expr? )?
atom = ident | 'NUM' | 'STR'+ | '...' | 'None' | 'True' | 'False' | '(' ( yieldexpr | starred_or ( compfor | ( ',' starred_or )* ','? ) )? ')' | '[' ( starred_or ( compfor | ( ',' starred_or )* ','? ) )? ']' | '{' ( setitem ( compfor | ( ',' setitem )* ','? ) )? '}'
setitem = starred_or | expr ':' expr | '**' expr
compfor = ( 'async'? 'for' targets 'in' orx_or_lambda ( 'if' orx_named )* )+
orx_or_lambda = expr
orx_named = orx ( ':=' expr )? | lambda
"""

_SCRIPT = """
file = item*
item = stmt | import_ | export_
stmt = block | vardecl ';' | function | classdecl | 'if' '(' expr ')' stmt ( 'else' stmt )? | 'for' 'await'? '(' forhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'? | 'try' block ( 'catch' ( '(' binding ')' )? block )? ( 'finally' block )? | 'switch' '(' expr ')' '{' ( 'case' expr ':' stmt* | 'default' ':' stmt* )* '}' | 'return' expr? ';' | 'throw' expr ';' | 'break' ident? ';' | 'continue' ident? ';' | 'debugger' ';' | 'with' '(' expr ')' stmt | ';' | ident ':' stmt | expr ';' @STMT@
block = '{' stmt* '}'
vardecl = ( 'var' | 'let' | 'const' ) declarator ( ',' declarator )*
declarator = binding ( '=' assign )?
binding = ( ident | objpattern | arrpattern ) @ANNOT@
objpattern = '{' ( objbind ( ',' objbind )* ','? )? '}'
objbind = propname ':' bindtarget ( '=' assign )? | ident ( '=' assign )? | '...' bindtarget
bindtarget = ident | objpattern | arrpattern
arrpattern = '[' ( ','* arrbind ( ','+ arrbind )* ','* | ','* ) ']'
arrbind = '...'? bindtarget ( '=' assign )?
forhead = ( vardecl | expr )? ';' expr? ';' expr? | ( 'var' | 'let' | 'const' ) binding ( 'of' assign | 'in' expr ) | lhs ( 'of' assign | 'in' expr )
function = 'async'? 'function' '*'? ident signature fbody
signature = @GENERICS@ '(' params? ')' @RET@
params = param ( ',' param )* ','?
param = decorator* @ACCESS@ ( '...' )? bindtarget @OPTANNOT@ ( '=' assign )? @THISPARAM@
fbody = block @NOBODY@
classdecl = decorator* @ABSTRACT@ 'class' ident? @GENERICS@ ( 'extends' lhs @TYPEARGS@ )? @IMPLEMENTS@ '{' member* '}'
decorator = '@' lhs
member = ';' | decorator* modifier* ( ( 'get' | 'set' | 'async' | '*' | 'async' '*' )? propname signature mbody | propname @OPTANNOT@ ( '=' assign )? ';' | 'static' block ) @MEMBER@
mbody = block @NOBODY@
modifier = 'static' @MODIFIERS@
propname = name | 'STR' | 'NUM' | '[' assign ']'
expr = assign ( ',' assign )*
assign = arrow | 'yield' ( '*'? assign )? | operand ( binop operand )* ( '?' assign ':' assign )? ( assignop assign )? | operand ( binop operand )* binop arrow
arrow = 'async'? ( ident | arrowparams ) '=>' ( block | assign )
arrowparams = @GENERICS@ '(' params? ')' @RET@
operand = prefix* lhs ( '++' | '--' )? @AS@
prefix = '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' @CAST@
binop = '*' | '/' | '%' | '+' | '-' | '**' | '<<' | '<' | '>' '>'? '>'? | '<=' | '>=' | 'in' | 'instanceof' | '==' | '!=' | '===' | '!==' | '&' | '^' | '|' | '&&' | '||' | '??'
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
lhs = 'new'* primary suffix*
suffix = '.' name | '?.' ( name | '(' args? ')' | '[' expr ']' ) | '(' args? ')' | '[' expr ']' | 'TPL' @SUFFIX@
args = ( '...'? assign ) ( ',' '...'? assign )* ','?
primary = ident | 'NUM' | 'STR' | 'TPL' | 'REGEX' | 'JSX' | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | '[' ( ','* elem ( ','+ elem )* ','* | ','* ) ']' | '{' ( prop ( ',' prop )* ','? )? '}' | 'async'? 'function' '*'? ident? signature block | classdecl | 'import' ( '(' args ')' | '.' name )
elem = '...'? assign
prop = propname ':' assign | ident ( '=' assign )? | '...' assign | ( 'get' | 'set' | 'async' | '*' | 'async' '*' )? propname signature block
import_ = 'import' ( 'STR' | @TYPEONLY@ importclause 'from' 'STR' ) importattrs? ';' @IMPORTEQ@
importattrs = 'with' '{' ( propname ':' 'STR' ( ',' propname ':' 'STR' )* ','? )? '}'
importclause = ident ( ',' ( '*' 'as' ident | namedspecs ) )? | '*' 'as' ident | namedspecs
namedspecs = '{' ( spec ( ',' spec )* ','? )? '}'
spec = @TYPEONLY@ ( name | 'STR' ) ( 'as' ( name | 'STR' ) )?
export_ = 'export' ( '*' ( 'as' ( name | 'STR' ) )? 'from' 'STR' importattrs? ';' | @TYPEONLY@ namedspecs ( 'from' 'STR' importattrs? )? ';' | 'default' ( function0 | classdecl | assign ';' @DEFAULT@ ) | vardecl ';' | function | classdecl @EXPORT@ )
function0 = 'async'? 'function' '*'? ident? signature fbody
ident = 'ID' | 'async' | 'of' | 'get' | 'set' | 'static' | 'from' | 'as' | 'let' @IDENT@
name = ident | 'await' | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'export' | 'extends' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'false' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' | 'yield' @NAME@
"""

_JS_SLOTS: dict[str, str] = {}
_TS_SLOTS = {
    "STMT": "| tsdecl",
    "ANNOT": "( '!'? ':' type )?",
    "GENERICS": "generics?",
    "RET": "( ':' rettype )?",
    "ACCESS": "accessor*",
    "OPTANNOT": "( '?' | '!' )? ( ':' type )?",
    "THISPARAM": "| 'this' ':' type",
    "NOBODY": "| ';'",
    "ABSTRACT": "'abstract'?",
    "TYPEARGS": "typeargs?",
    "IMPLEMENTS": "( 'implements' typeref ( ',' typeref )* )?",
    "MEMBER": "| modifier* '[' ident ':' type ']' ':' type ';'",
    "MODIFIERS": "| accessor | 'abstract' | 'declare'",
    "AS": "( ( 'as' | 'satisfies' ) ( type | 'const' ) )*",
    "CAST": "| '<' ( type | 'const' ) '>'",
    "SUFFIX": "| '!' | typeargs ( '(' args? ')' | 'TPL' )",
    "TYPEONLY": "'type'?",
    "IMPORTEQ": "| 'import' ident '=' lhs ';'",
    "EXPORT": "| tsdecl | '=' assign ';' | 'as' 'namespace' ident ';'",
    "DEFAULT": "| interface",
    "IDENT": "| 'type' | 'declare' | 'namespace' | 'module' | 'keyof' | 'infer' | 'is' | 'satisfies' | 'unique' | 'override' | 'abstract' | 'readonly' | 'asserts' | 'public' | 'private' | 'protected' | 'interface' | 'implements'",
    "NAME": "| 'enum'",
}
_TS_RULES = """
accessor = 'public' | 'private' | 'protected' | 'readonly' | 'override'
tsdecl = interface | 'type' ident generics? '=' type ';' | 'const'? 'enum' ident '{' ( enumitem ( ',' enumitem )* ','? )? '}' | ( 'namespace' | 'module' ) ( ident ( '.' ident )* | 'STR' ) '{' item* '}' | 'declare' ( vardecl ';' | function | classdecl | tsdecl ) | 'declare' ident block
interface = 'interface' ident generics? ( 'extends' typeref ( ',' typeref )* )? objtype
enumitem = propname ( '=' assign )?
generics = '<' generic ( ',' generic )* ','? '>'
generic = ( 'const' | 'in' | 'out' )? ident ( 'extends' type )? ( '=' type )?
typeargs = '<' type ( ',' type )* '>'
rettype = type | 'asserts'? ( ident | 'this' ) 'is' type | 'asserts' ident
type = uniontype ( 'extends' uniontype '?' type ':' type )? | functype
functype = 'abstract'? 'new'? generics? '(' ftparams? ')' '=>' rettype
ftparams = ftparam ( ',' ftparam )* ','?
ftparam = '...'? ( bindtarget | 'this' ) '?'? ( ':' type )?
uniontype = ( '|' | '&' )? posttype ( ( '|' | '&' ) posttype )*
posttype = ( 'keyof' | 'unique' | 'readonly' | 'infer' )* atomtype ( '[' type? ']' )*
atomtype = typeref | 'this' | 'void' | 'null' | 'true' | 'false' | '-'? 'NUM' | 'STR' | 'TPL' | objtype | '(' type ')' | '(' functype ')' | '[' ( tupleitem ( ',' tupleitem )* ','? )? ']' | 'typeof' typeref | 'import' '(' 'STR' ')' ( '.' name )* typeargs?
tupleitem = '...'? type '?'? | '...'? ident '?'? ':' type
typeref = ident ( '.' name )* typeargs?
objtype = '{' ( typemember ( ( ';' | ',' ) typemember )* ( ';' | ',' )? )? '}'
typemember = ( 'readonly' | '+' 'readonly' | '-' 'readonly' )? ( propname ( '?' | '-' '?' )? ( ':' type )? | ( 'get' | 'set' )? propname '?'? signature | '[' ident ( ':' type | 'in' type ( 'as' type )? ) ']' ( '?' | '-' '?' | '+' '?' )? ( ':' type )? ) | 'new'? generics? '(' params? ')' ( ':' rettype )?
"""

JAVA = """
file = ( annotation* 'package' dotted ';' )? ( import_ | ';' )* typedecl*
import_ = 'import' 'static'? dotted ( '.' '*' )? ';'
dotted = ident ( '.' ident )*
ident = 'ID' | 'record' | 'var' | 'sealed' | 'permits' | 'when' | 'yield'
typedecl = modifier* ( class_ | interface_ | enum_ | record_ | annotype ) | ';'
modifier = annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'ID' '-' 'sealed'
annotation = '@' dotted ( '(' annargs? ')' )?
annargs = annarg ( ',' annarg )*
annarg = ident '=' annvalue | annvalue
annvalue = annotation | '{' ( annvalue ( ',' annvalue )* ','? )? '}' | ternary
class_ = 'class' ident generics? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? body
interface_ = 'interface' ident generics? ( 'extends' types )? ( 'permits' types )? body
annotype = '@' 'interface' ident body
enum_ = 'enum' ident ( 'implements' types )? '{' ( enumconst ( ',' enumconst )* ','? )? ( ';' member* )? '}'
enumconst = annotation* ident ( '(' args? ')' )? body?
record_ = 'record' ident generics? '(' params? ')' ( 'implements' types )? body
body = '{' member* '}'
member = ';' | 'static'? block | modifier* ( class_ | interface_ | enum_ | record_ | annotype | generics? ( type | 'void' ) ident '(' params? ')' dims ( 'throws' types )? ( block | ';' | 'default' annvalue ';' ) | generics? ident '(' params? ')' ( 'throws' types )? block | ident block | type declarators ';' )
declarators = declarator ( ',' declarator )*
declarator = ident dims ( '=' varinit )?
varinit = expr | arrayinit
arrayinit = '{' ( varinit ( ',' varinit )* ','? )? '}'
dims = ( annotation* '[' ']' )*
params = param ( ',' param )*
param = ( 'final' | annotation )* type ( '...' )? ( ident '.' )? ( ident | 'this' ) dims
generics = '<' generic ( ',' generic )* '>'
generic = annotation* ident ( 'extends' type ( '&' type )* )?
types = type ( ',' type )*
prim = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double'
type = annotation* ( prim | classtype ) dims
classtype = ident typeargs? ( '.' annotation* ident typeargs? )*
typeargs = '<' ( typearg ( ',' typearg )* )? '>'
typearg = annotation* '?' ( ( 'extends' | 'super' ) type )? | type
block = '{' blockstmt* '}'
blockstmt = ( 'final' | annotation )* type declarators ';' | modifier* ( class_ | interface_ | enum_ | record_ ) | stmt
stmt = block | ';' | 'if' '(' expr ')' stmt ( 'else' stmt )? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' forhead ')' stmt | 'return' expr? ';' | 'throw' expr ';' | 'break' ident? ';' | 'continue' ident? ';' | 'yield' expr ';' | 'assert' expr ( ':' expr )? ';' | 'synchronized' '(' expr ')' block | 'try' ( '(' resource ( ';' resource )* ';'? ')' )? block ( 'catch' '(' ( 'final' | annotation )* type ( '|' type )* ident ')' block )* ( 'finally' block )? | switch | ident ':' stmt | exprstmt ';'
exprstmt = expr
forhead = ( ( 'final' | annotation )* type declarators | expr ( ',' expr )* )? ';' expr? ';' ( expr ( ',' expr )* )? | ( 'final' | annotation )* type ident ':' expr
resource = ( 'final' | annotation )* type ident '=' expr | expr
switch = 'switch' '(' expr ')' '{' ( label blockstmt* )* '}' | 'switch' '(' expr ')' '{' ( arrowlabel ( expr ';' | block | 'throw' expr ';' ) )* '}'
label = 'case' caseitem ( ',' caseitem )* guard? ':' | 'default' ':'
arrowlabel = 'case' caseitem ( ',' caseitem )* guard? '->' | 'default' '->'
caseitem = ternary | pattern | 'default'
guard = 'when' expr
pattern = ( 'final' | annotation )* type ident | type '(' ( pattern ( ',' pattern )* )? ')' ident?
expr = ternary ( assignop expr )? | lambda
ternary = operand ( binop operand | 'instanceof' ( 'final'? type ident? | pattern ) )* ( '?' expr ':' ( ternary | lambda ) )?
lambda = ( ident | '(' ( ident ( ',' ident )* | params )? ')' ) '->' ( expr | block )
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>' '>' '>='
binop = '*' | '/' | '%' | '+' | '-' | '<<' | '<' | '>' '>'? '>'? | '<=' | '>=' | '==' | '!=' | '&' | '^' | '|' | '&&' | '||'
operand = ( '+' | '-' | '++' | '--' | '!' | '~' | '(' type ( '&' type )* ')' )* ( primary suffix* ( '++' | '--' )? | '(' type ( '&' type )* ')' lambda )
primary = 'NUM' | 'STR' | 'true' | 'false' | 'null' | 'this' | 'super' | ident | '(' expr ')' | 'new' creator | switch | ( prim dims | 'void' ) '.' 'class' | classtype dims '::' ( ident | 'new' ) | prim dims '::' 'new' | ident ( '.' ident )* ( '[' ']' )+ '.' 'class'
creator = annotation* ( classtype '(' args? ')' body? | ( prim | classtype ) ( '[' expr ']' )+ dims | ( prim | classtype ) '[' ']' dims arrayinit )
suffix = '.' ( typeargs? ( ident | 'super' ) | 'this' | 'class' | 'new' creator ) | '(' args? ')' | '[' expr ']' | '::' ( ident | 'new' )
args = expr ( ',' expr )*
"""

CPP = """
file = decl*
decl = ';' | 'inline'? 'namespace' attr* ( ident ( '::' 'inline'? ident )* )? ( '{' decl* '}' | '=' qualified ';' ) | 'extern' 'STR' ( '{' decl* '}' | decl ) | 'template' ( '<' ( tparam ( ',' tparam )* )? '>' )? requires? decl | using | 'static_assert' '(' args ')' ';' | 'typedef' simpledecl | 'concept' ident '=' expr ';' | attr* specifier* ( typedef_ declspec* declarators? ';' | typ declspec* declarators? ';' | typ declspec* functor fbody | typ declspec* declarator brace ';' | functor fbody ) | 'asm' '(' args ')' ';'
simpledecl = specifier* ( typedef_ | typ ) declspec* declarators? ';'
requires = 'requires' expr
using = 'using' ( 'namespace' qualified | 'typename'? qualified ( ',' qualified )* | 'enum' qualified | ident attr* '=' typeid ) ';'
attr = '[' '[' ( attritem ( ',' attritem )* )? ']' ']' | 'alignas' '(' args ')'
attritem = ident ( '::' ident )? ( '(' args? ')' )?
specifier = 'static' | 'extern' | 'inline' | 'virtual' | 'explicit' ( '(' expr ')' )? | 'friend' | 'constexpr' | 'consteval' | 'constinit' | 'mutable' | 'thread_local' | 'register' | 'const' | 'volatile' | 'typename'
declspec = 'const' | 'volatile' | 'static' | 'inline' | 'constexpr'
typedef_ = ( 'class' | 'struct' | 'union' ) attr* ( qualified 'final'? )? ( ':' base ( ',' base )* )? '{' member* '}' | 'enum' ( 'class' | 'struct' )? attr* qualified? ( ':' typ )? '{' ( enumitem ( ',' enumitem )* ','? )? '}'
base = ( 'public' | 'private' | 'protected' | 'virtual' )* qualified '...'?
member = ( 'public' | 'private' | 'protected' ) ':' | decl | attr* specifier* typ declspec* declarator ':' expr ( '=' expr )? ';'
enumitem = ident attr* ( '=' ternary )?
tparam = ( 'typename' | 'class' | ident ) '...'? ident? ( '=' typeid )? | typ declarator? ( '=' operand )? | 'template' '<' ( tparam ( ',' tparam )* )? '>' ( 'class' | 'typename' ) '...'? ident? ( '=' typeid )? | qualified '...'? ident? ( '=' typeid )?
prim = 'void' | 'bool' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | 'wchar_t' | 'auto'
typ = prim ( prim | 'const' | 'volatile' )* | ( 'class' | 'struct' | 'union' | 'enum' | 'typename' )? qualified ( 'auto' )? | 'decltype' '(' expr ')'
qualified = '::'? part ( '::' 'template'? part )*
part = ident ( '<' ( targ ( ',' targ )* )? '>' )? | '~' ident | 'operator' opname
ident = 'ID' | 'final' | 'override'
targ = typeid '...'? | operand ( targop operand )* '...'?
targop = '*' | '/' | '%' | '+' | '-' | '&' | '|' | '==' | '!=' | '&&' | '||'
typeid = specifier* typ declspec* abstract?
abstract = ptr* ( '(' ptr* ')' )? ( '(' params? ')' fspec* | '[' expr? ']' )* ( '->' typeid )?
ptr = '*' | '&' | '&&' | 'const' | 'volatile' | qualified '::' '*'
declarators = initdecl ( ',' initdecl )*
initdecl = declarator ( '=' init | '(' args? ')' | brace )? 
declarator = ptr* ( qualified attr* | '(' declarator ')' | '...' ident? | '[' ident ( ',' ident )* ']' ) ( '[' expr? ']' | '(' params? ')' fspec* ( '->' typeid )? )*
functor = ptr* qualified '(' params? ')' fspec* ( '->' typeid )? requires?
fspec = 'const' | 'volatile' | '&' | '&&' | 'override' | 'final' | 'noexcept' ( '(' expr ')' )? | 'throw' '(' ( typeid ( ',' typeid )* )? ')' | attr
fbody = ';' | ( ':' meminit ( ',' meminit )* )? block | 'try' block catch+ | '=' ( 'default' | 'delete' | 'NUM' ) ';'
meminit = qualified ( '(' args? ')' | brace ) '...'?
params = param ( ',' param )* ( ',' '...' )? | '...'
param = attr* specifier* typ declspec* ( declarator | abstract )? ( '=' init )?
init = expr1 | brace
brace = '{' ( initem ( ',' initem )* ','? )? '}'
initem = init '...'? | '.' ident ( '=' init | brace ) | '[' expr ']' '=' init
opname = 'new' ( '[' ']' )? | 'delete' ( '[' ']' )? | '(' ')' | '[' ']' | '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '~' | '!' | '=' | '<' | '>' '>'? '='? | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<' | '<<=' | '>>=' | '==' | '!=' | '<=' | '>=' | '<=>' | '&&' | '||' | '++' | '--' | ',' | '->' | '->*' | 'STR' ident | 'bool' | typeid
block = '{' stmt* '}'
stmt = attr* ( block | ';' | 'if' 'constexpr'? '(' cond ')' stmt ( 'else' stmt )? | 'while' '(' cond ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' forhead ')' stmt | 'switch' '(' cond ')' stmt | 'case' ternary ( '...' ternary )? ':' stmt | 'default' ':' stmt | 'return' ( expr | brace )? ';' | 'co_return' expr? ';' | 'break' ';' | 'continue' ';' | 'goto' ident ';' | 'try' block catch+ | ident ':' stmt | localdecl | using | 'static_assert' '(' args ')' ';' | 'typedef' simpledecl | expr ';' )
catch = 'catch' '(' ( '...' | param ) ')' block
cond = ( localhead ';' | expr? ';' )? ( expr | specifier* typ declspec* declarator ( '=' init | brace ) )
localdecl = localhead ';' | specifier* typedef_ declarators? ';'
localhead = specifier* typ declspec* declarators
forhead = ( localhead | expr )? ';' expr? ';' expr? | ( expr ';' | localhead ';' )? attr* specifier* typ declspec* declarator ':' ( expr | brace )
expr = expr1 ( ',' expr1 )*
expr1 = ternary ( assignop ( expr1 | brace ) )? | 'throw' expr1? | 'co_yield' expr1
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='
ternary = operand ( binop operand )* ( '?' expr ':' expr1 )?
binop = '*' | '/' | '%' | '+' | '-' | '<<' | '<' | '>' '>'? | '<=' | '>=' | '<=>' | '==' | '!=' | '&' | '^' | '|' | '&&' | '||' | '->*' | '.' '*'
operand = prefix* primary suffix*
prefix = '+' | '-' | '*' | '&' | '&&' | '!' | '~' | '++' | '--' | 'sizeof' '...'? | 'alignof' | 'co_await' | '(' typeid ')' | 'delete' ( '[' ']' )? | '::' 'delete'
primary = 'NUM' | 'STR'+ ident? | 'true' | 'false' | 'nullptr' | 'this' | qualified brace? | '(' expr ')' | '(' '...' binop operand ')' | '(' operand binop '...' ( binop operand )? ')' | prim+ ( '(' args? ')' | brace ) | ( 'static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast' ) '<' typeid '>' '(' expr ')' | ( 'typeid' | 'sizeof' | 'alignof' | 'noexcept' ) '(' ( expr | typeid ) ')' | 'decltype' '(' expr ')' ( '(' args? ')' | brace )? | '::'? 'new' ( '(' args ')' )? ( '(' typeid ')' | specifier* typ newptr* ) ( '[' expr? ']' )* ( '(' args? ')' | brace )? | lambda | 'requires' ( '(' params? ')' )? '{' reqitem* '}'
newptr = '*' | '&' | 'const'
reqitem = expr ';' | '{' expr '}' 'noexcept'? ( '->' typeid )? ';' | 'typename' qualified ';' | 'requires' expr ';'
lambda = '[' ( capture ( ',' capture )* )? ']' ( '<' tparam ( ',' tparam )* '>' )? ( '(' params? ')' )? ( 'mutable' | 'constexpr' | 'noexcept' )* ( '->' typeid )? block
capture = '&' | '=' | '&'? ident '...'? ( '=' init )? | '*'? 'this' | '...' ident
suffix = ( '.' | '->' ) 'template'? qualified | '(' args? ')' | '[' ( expr | brace )? ']' | '++' | '--' | '...'
args = ( expr1 | brace ) ( ',' ( expr1 | brace ) )*
"""


def _script(slots: dict[str, str], more: str) -> str:
    """The rules both script languages share, with a language's own text in the slots @NAME@."""
    return re.sub(r"@([A-Z]+)@", lambda m: slots.get(m[1], ""), _SCRIPT) + more


@lru_cache(None)
def grammar(language: str) -> Grammar:
    """The grammar of a language; one per Python worker, so that its memo serves all files."""
    text = {"python": PYTHON, "java": JAVA, "cpp": CPP}.get(language)
    if text is None:
        text = _script(_TS_SLOTS, _TS_RULES) if language == "typescript" else _script(_JS_SLOTS, "")
    return Grammar(text, "file")

"""Dialect grammars for :mod:`siltstone.llm.gll`, one text per language.

Notation: ``rule := alternatives ;;``, quoted terminals, UPPER-CASE token
classes, ``* + ?`` and parentheses.  A quoted bracket pair is one unit.
Operator precedence is left out: only membership matters here.
"""

from __future__ import annotations

PYTHON = r"""
file := 'NEWLINE'? stmt* ;;
fexpr := yieldexpr | starexprs ;;
block := 'NEWLINE' 'INDENT' stmt+ 'DEDENT' | simples ;;
simples := simple (';' simple)* ';'? 'NEWLINE' ;;
stmt := simples | compound ;;
simple := starexprs | yieldexpr | (targets '=')+ (starexprs | yieldexpr) | target AUG (starexprs | yieldexpr)
  | target ':' expr ('=' (starexprs | yieldexpr))?
  | 'pass' | 'break' | 'continue' | 'return' starexprs? | 'raise' (expr ('from' expr)?)? | 'del' deltargets
  | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)* | 'assert' expr (',' expr)?
  | 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)*
  | 'from' (('.' | '...')+ dotted? | dotted) 'import' ('*' | imports | '(' imports ','? ')')
P312>  | 'type' NAME tparams? '=' expr
  ;;
imports := NAME ('as' NAME)? (',' NAME ('as' NAME)?)* ;;
dotted := NAME ('.' NAME)* ;;
deltargets := target (',' target)* ','? ;;
targets := '*'? target (',' '*'? target)* ','? ;;
target := NAME | '(' targets? ')' | '[' targets? ']' | atom trailer* ('.' NAME | '[' subscript ']') ;;
compound := 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
  | 'while' named ':' block ('else' ':' block)?
  | 'async'? 'for' targets 'in' starexprs ':' block ('else' ':' block)?
  | 'async'? 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' block
  | 'try' ':' block (('except' '*'? (expr ('as' NAME)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block)
  | ('@' named 'NEWLINE')* ('class' NAME tparams? ('(' args? ')')? ':' block
      | 'async'? 'def' NAME tparams? '(' params? ')' ('->' expr)? ':' block)
P310>  | 'match' (starnamed (',' starnamed)* ','?) ':' 'NEWLINE' 'INDENT' ('case' patterns ('if' named)? ':' block)+ 'DEDENT'
  ;;
withitem := expr ('as' target)? ;;
tparams := '[' tparam (',' tparam)* ','? ']' ;;
tparam := ('*' | '**')? NAME (':' expr)? ('=' starexprs)? ;;
param := NAME (':' expr)? ;;
default := NAME (':' expr)? '=' expr ;;
params := (param (',' param)* (',' '/' (',' param)*)? (',' default)* (',' '/' (',' default)*)? | default (',' default)* (',' '/' (',' default)*)?)
    (',' rest)? ','? | rest ','? ;;
rest := '*' NAME (':' '*'? expr)? (',' (param | default))* (',' '**' param)? | '*' (',' (param | default))+ (',' '**' param)? | '**' param ;;
lparam := NAME ;;
ldefault := NAME '=' expr ;;
lparams := (lparam (',' lparam)* (',' '/' (',' lparam)*)? (',' ldefault)* (',' '/' (',' ldefault)*)? | ldefault (',' ldefault)* (',' '/' (',' ldefault)*)?)
    (',' lrest)? ','? | lrest ','? ;;
lrest := '*' NAME (',' (lparam | ldefault))* (',' '**' lparam)? | '*' (',' (lparam | ldefault))+ (',' '**' lparam)? | '**' lparam ;;
yieldexpr := 'yield' ('from' expr | starexprs)? ;;
starexprs := star (',' star)* ','? ;;
star := '*' arith | expr ;;
starnamed := '*' arith | named ;;
named := (NAME ':=')? expr ;;
expr := (disj 'if' disj 'else')* (disj | 'lambda' lparams? ':' expr) ;;
disj := inv (('and' | 'or') inv)* ;;
inv := 'not'* arith (('<' | '>' | 'CMP' | 'in' | 'not' 'in' | 'is' 'not'?) arith)* ;;
arith := unary (('+' | '-' | '*' | '**' | 'BIN' | '/' | '@') unary)* ;;
unary := ('+' | '-' | '~')* 'await'? atom trailer* ;;
trailer := '.' NAME | '(' args? ')' | '[' subscript ']' ;;
atom := NAME | NUM | STR+ | '...' | 'None' | 'True' | 'False'
  | '(' (yieldexpr | starnamed comp | starnamed (',' starnamed)* ','?)? ')'
  | '[' (starnamed comp | starnamed (',' starnamed)* ','?)? ']'
  | '{' (starnamed comp | starnamed (',' starnamed)* ','? | pair comp | pair (',' pair)* ','?)? '}' ;;
pair := expr ':' expr | '**' arith ;;
comp := ('async'? 'for' targets 'in' disj ('if' (NAME ':=')? disj)*)+ ;;
args := arg (',' arg)* ','? | named comp ;;
arg := NAME '=' expr | '*' expr | '**' expr | named ;;
subscript := slice (',' slice)* ','? ;;
slice := starnamed | expr? ':' expr? (':' expr?)? ;;
patterns := pattern (',' pattern)* ','? ;;
pattern := '*' NAME | closed ('|' closed)* ('as' NAME)? ;;
closed := '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False'
  | NAME ('.' NAME)* ('(' (patarg (',' patarg)* ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']'
  | '{' (patpair (',' patpair)* ','?)? '}' ;;
patarg := NAME '=' pattern | pattern ;;
patpair := (STR+ | '-'? NUM (('+' | '-') NUM)? | 'None' | 'True' | 'False' | NAME ('.' NAME)+) ':' pattern | '**' NAME ;;
"""

JSON = r"""
value := STR | NUM | 'true' | 'false' | 'null' | '{' (STR ':' value (',' STR ':' value)*)? '}' | '[' (value (',' value)*)? ']' ;;
"""

#: JavaScript; a line with TS> belongs to the TypeScript dialects only, JS> to the JavaScript ones.
ECMA = r"""
program := stmt* ;;
term := ';' | 'NL' ;;
last := term? ;;
block := '{' stmts '}' ;;
stmts := stmt* ;;
stmt := block | ';' | decl | sexpr term
  | 'if' '(' expr ')' stmt ('else' stmt)?
  | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' term?
  | 'for' 'await'? '(' forhead ')' stmt
  | ('continue' | 'break') NAME? term | 'return' expr? term | 'throw' expr term | 'debugger' term
  | 'try' block ('catch' ('(' param ')')? block ('finally' block)? | 'finally' block)
  | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}'
  | NAME ':' stmt
SCRIPT>  | 'with' '(' expr ')' stmt
MODULE>  | 'import' (importclause 'from')? STR (('with' | 'assert') '{' attrs? '}')? term
MODULE>  | 'export' (decl | 'default' (funcdecl | classdecl | assign term) | ('*' ('as' modname)? | '{' specs? '}') 'from' STR (('with' | 'assert') '{' attrs? '}')? term | '{' specs? '}' term)
TSM>  | 'export' 'default' 'interface' NAME typarams? ('extends' type (',' type)*)? '{' members '}'
TSM>  | 'export' '=' expr term | 'export' 'as' 'namespace' NAME term | 'export' 'type' ('{' specs? '}' ('from' STR)? | '*' ('as' NAME)? 'from' STR) term
TSM>  | 'export'? 'import' 'type'? NAME '=' expr term | 'import' 'type' importclause 'from' STR term
  ;;
decl := ('var' | 'let' | 'const') vars term | funcdecl | classdecl
TS>  | ('export' | 'declare')* typedecl
  ;;
TS> typedecl := 'interface' NAME typarams? ('extends' type (',' type)*)? '{' members '}' | 'type' NAME typarams? '=' type term
TS>  | 'const'? 'enum' NAME '{' (enumitem (',' enumitem)* ','?)? '}' | ('namespace' | 'module') (NAME ('.' NAME)* | STR) ('{' stmts '}' | term)
TS>  | 'global' '{' stmts '}' | 'declare' (('var' | 'let' | 'const') vars term | funcdecl | classdecl) ;;
TS> enumitem := (NAME | STR | '[' STR ']') ('=' assign)? ;;
attrs := (NAME | STR) ':' STR (',' (NAME | STR) ':' STR)* ','? ;;
importclause := NAME (',' ('*' 'as' NAME | '{' specs? '}'))? | '*' 'as' NAME | '{' specs? '}' ;;
specs := spec (',' spec)* ','? ;;
spec := 
TS>  'type'?
  modname ('as' modname)? ;;
modname := IDNAME | STR ;;
vars := var (',' var)* ;;
var := target 
TS>  '!'? (':' type)?
  ('=' assign)? ;;
target := NAME | '[' elems ']' | '{' props '}' ;;
forhead := (('var' | 'let' | 'const') vars | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') target | postfix) ('of' assign | 'in' expr) ;;
funcdecl := 'async'? 'function' '*'? NAME? sig
JS> block
TS> (block | term)
  ;;
sig := 
TS>  typarams?
  '(' params? ')'
TS>  (':' rettype)?
  ;;
params := param (',' param)* ','? ;;
param := 
TS>  decorator* ('public' | 'private' | 'protected' | 'readonly' | 'override')*
  '...'? (target
TS>  | 'this'
  )
TS>  '?'? (':' type)?
  ('=' assign)? ;;
decorator := '@' (NAME | '(' expr ')') ('.' NAME | '(' args? ')')* 'NL'? ;;
classdecl := decorator*
TS>  'abstract'?
  'class' NAME?
TS>  typarams?
  ('extends' postfix
TS>  typeargs?
  )?
TS>  ('implements' type (',' type)*)?
  '{' member* '}' ;;
member := ';' | 'static' block | decorator* ('static' | 'async' | 'get' | 'set' | '*' | 'accessor'
TS>  | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'
  )* propname (sig
JS> block
TS> (block | term) | ('?' | '!')? (':' type)? ('=' assign)? term | '?' sig (block | term)
JS> | ('=' assign)? term
  )
TS>  | ('static' | 'readonly')* '[' NAME ':' type ']' ':' type term
  ;;
propname := IDNAME | STR | NUM | PRIVATE | '[' assign ']' ;;
props := (prop (',' prop)* ','?)? ;;
prop := '...' assign | propname ':' assign | NAME ('=' assign)? | ('async' | 'get' | 'set' | '*')* propname sig block ;;
elems := (','* ('...' )? assign)* ','* ;;
args := '...'? assign (',' '...'? assign)* ','? ;;
expr := assign (',' assign)* ;;
assign := unary chain* ;;
sexpr := (prefix+ (postfix | arrow '{' stmts '}') | arrow '{' stmts '}' | spostfix) chain* (',' assign)* ;;
chain := ('BIN' | '*' | '<' | '>' ('>' '>'?)? '='? | 'ASGN' | '=' | 'in' | 'instanceof' | '+' | '-' | '/' | '?' assign ':') unary
TS>  | ('as' | 'satisfies') (type | 'const')
  ;;
unary := prefix* (postfix | arrow '{' stmts '}' | 'yield') ;;
prefix := '!' | '~' | '+' | '-' | 'INC' | 'typeof' | 'void' | 'delete' | 'await' | 'yield' '*'? | 'new' | arrow 
TS>  | typeargs
  ;;
arrow := 'async'? (NAME | sig) '=>' ;;
postfix := primary trailer* 'INC'? ;;
spostfix := sprimary trailer* 'INC'? ;;
trailer := '.' (IDNAME | PRIVATE) | '?.' (IDNAME | PRIVATE | '(' args? ')' | '[' expr ']') | '(' args? ')' | '[' expr ']' | template
TS>  | '!' | typeargs
  ;;
primary := sprimary | '{' props '}' | 'async'? 'function' '*'? NAME? sig block | classdecl ;;
sprimary := NAME | NUM | STR | template | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | PRIVATE
  | '(' expr ')' | '[' elems ']' | 'import' ('(' args ')' | '.' NAME) | 'new' '.' NAME ;;
template := TPL | 'TPLOPEN' '${' expr '}' ('TPLMID' '${' expr '}')* 'TPLEND' ;;
TS> typarams := '<' typaram (',' typaram)* ','? '>' ;;
TS> typaram := ('const' | 'in' | 'out')* NAME ('extends' type)? ('=' type)? ;;
TS> typeargs := '<' type (',' type)* ','? '>' ;;
TS> rettype := type | 'asserts' (NAME | 'this') ('is' type)? | (NAME | 'this') 'is' type ;;
TS> members := (memb (';' | ',' | 'NL'))* memb? ;;
TS> memb := ('readonly' | '+' 'readonly' | '-' 'readonly' | 'get' | 'set')* propname '?'? (':' type | msig)? | msig | 'new' msig
TS>  | ('readonly' | '+' 'readonly' | '-' 'readonly')? '[' NAME (':' type | 'in' type ('as' type)?) ']' (('+' | '-')? '?')? (':' type)? ;;
TS> msig := typarams? '(' params? ')' (':' rettype)? ;;
TS> type := tun ('extends' type '?' type ':' type)? | 'abstract'? 'new'? typarams? '(' params? ')' '=>' rettype ;;
TS> tun := 'BAR'? tpre (('BAR' | 'AMP') tpre)* ;;
TS> tpre := ('keyof' | 'unique' | 'readonly' | 'infer')* tprim ('[' type? ']')* ;;
TS> tprim := NAME ('.' IDNAME)* typeargs? | 'typeof' (NAME | 'this' | 'import' '(' type ')') ('.' IDNAME)* typeargs? | STR | '-'? NUM | 'this' | 'void' | 'null' | 'true' | 'false'
TS>  | '{' members '}' | '[' (telem (',' telem)* ','?)? ']' | '(' type ')' | ttemplate | 'import' '(' type ')' ('.' IDNAME)* typeargs? ;;
TS> telem := '...'? (NAME '?'? ':')? '...'? type '?'? ;;
TS> ttemplate := TPL | 'TPLOPEN' '${' type '}' ('TPLMID' '${' type '}')* 'TPLEND' ;;
"""

GO = r"""
file := 'package' NAME ';' ('import' (importspec | '(' (importspec ';')* importspec? ')') ';')* (top ';')* ;;
importspec := (NAME | '.')? STR ;;
top := decl | 'func' ('(' params ')')? NAME tparams? signature body? ;;
decl := 'const' (constspec | '(' (constspec ';')* constspec? ')') | 'var' (varspec | '(' (varspec ';')* varspec? ')')
  | 'type' (typespec | '(' (typespec ';')* typespec? ')') ;;
constspec := names type? ('=' exprs)? ;;
varspec := names (type ('=' exprs)? | '=' exprs) ;;
typespec := NAME tparams? '='? type ;;
tparams := '[' names constraint (',' names constraint)* ','? ']' ;;
constraint := '~'? type ('BAR' '~'? type)* ;;
names := NAME (',' NAME)* ;;
signature := '(' params ')' (type | '(' params ')')? ;;
params := (par (',' par)* ','?)? ;;
par := NAME? '...'? type ;;
type := NAME ('.' NAME)? ('[' type (',' type)* ','? ']')? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type
  | 'chan' '<-'? type | '<-' 'chan' type | 'func' signature | 'struct' '{' ((field ';')* field?) '}' | 'interface' '{' ((ielem ';')* ielem?) '}' | '(' type ')' ;;
field := (names type | '*'? NAME ('.' NAME)? ('[' type (',' type)* ']')?) STR? ;;
ielem := NAME signature | constraint ;;
body := '{' stmts '}' ;;
stmts := (stmt? ';')* stmt? ;;
stmt := decl | simple | NAME ':' stmt? | 'go' expr | 'defer' expr | 'return' exprs? | ('break' | 'continue' | 'goto') NAME? | 'fallthrough' | body | if
  | 'switch' (simple? ';')? (simple | NAME ':=' expr)? '{' (('case' typesorexprs | 'default') ':' stmts)* '}'
  | 'select' '{' (('case' simple | 'default') ':' stmts)* '}'
  | 'for' (expr | simple? ';' expr? ';' simple? | (exprs (':=' | '='))? 'range' expr)? body ;;
if := 'if' (simple? ';')? expr body ('else' 'if' (simple? ';')? expr body)* ('else' body)? ;;
typesorexprs := (expr | type) (',' (expr | type))* ;;
simple := expr ('INC' | '<-' expr)? | exprs (':=' | '=' | 'ASGN') exprs ;;
exprs := expr (',' expr)* ;;
expr := unary (('BIN' | '*' | 'AMP' | 'BAR' | '+' | '-' | '^' | '<' | '>') unary)* ;;
unary := ('+' | '-' | '!' | '^' | '*' | 'AMP' | '<-')* primary ;;
primary := (NUM | STR | NAME | '(' (expr | type) ')' | 'func' signature body | comptype) trailer* ;;
comptype := 'map' '[' type ']' type | '[' (expr | '...')? ']' type | 'struct' '{' ((field ';')* field?) '}' | 'chan' type | '*' type | 'interface' '{' ((ielem ';')* ielem?) '}' | 'func' signature ;;
trailer := '.' NAME | '.' '(' (type | 'type') ')' | '[' (expr | type) (',' (expr | type))* ','? ']' | '[' expr? ':' expr? (':' expr)? ']'
  | '(' ((expr | type) (',' (expr | type))* '...'? ','?)? ')' | lit ;;
lit := '{' (elem (',' elem)* ','?)? '}' ;;
elem := (value ':')? value ;;
value := expr | lit ;;
"""

#: LISTS> marks what the dialect with bracketed list literals adds to standard Java.
JAVA = r"""
file := (anno* 'package' qual ';')? ('import' 'static'? qual ('.' '*')? ';' | ';')* (typedecl | ';')* 
  | anno* 'open'? 'module' qual '{' (('requires' ('transitive' | 'static')* | 'exports' | 'opens' | 'uses' | 'provides') qual (('to' | 'with') qual (',' qual)*)? ';')* '}' ;;
qual := NAME ('.' NAME)* ;;
anno := '@' qual ('(' annoargs? ')')? ;;
annoargs := annoval | NAME '=' annoval (',' NAME '=' annoval)* ;;
annoval := expr | anno | '{' (annoval (',' annoval)* ','?)? '}' ;;
mod := anno | 'MOD' | 'static' | 'final' | 'abstract' | 'default' | 'synchronized' | 'sealed' | 'non' '-' 'sealed' | 'strictfp' ;;
typedecl := mod* ('class' NAME tparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody
  | 'interface' NAME tparams? ('extends' types)? ('permits' types)? classbody
  | 'record' NAME tparams? '(' params? ')' ('implements' types)? classbody
  | 'enum' NAME ('implements' types)? '{' (enumconst (',' enumconst)*)? ','? (';' member*)? '}'
  | '@' 'interface' NAME classbody) ;;
enumconst := anno* NAME ('(' args? ')')? classbody? ;;
classbody := '{' member* '}' ;;
member := ';' | 'static'? block | typedecl | mod* tparams? NAME '(' params? ')' throws? block | mod* NAME block
  | mod* tparams? (type | 'void') NAME '(' params? ')' dims throws? ('default' annoval)? (block | ';')
  | mod* type vars ';' ;;
throws := 'throws' types ;;
tparams := '<' tparam (',' tparam)* '>' ;;
tparam := anno* NAME ('extends' type ('AMP' type)*)? ;;
types := type (',' type)* ;;
type := anno* ('PRIM' | cls) dims ;;
dims := (anno* '[' ']')* ;;
cls := NAME targs? ('.' anno* NAME targs?)* ;;
targs := '<' (targ (',' targ)*)? '>' ;;
targ := type | anno* '?' (('extends' | 'super') type)? ;;
params := param (',' param)* ;;
param := mod* type (anno* '...')? (NAME | (NAME '.')? 'this') dims ;;
vars := var (',' var)* ;;
var := NAME dims ('=' init)? ;;
init := expr | '{' (init (',' init)* ','?)? '}' ;;
block := '{' stmt* '}' ;;
stmt := block | ';' | mod* type vars ';' | typedecl | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' ((mod* type vars | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? | mod* type NAME ':' expr) ')' stmt
  | 'return' expr? ';' | ('break' | 'continue') NAME? ';' | 'yield' expr ';' | 'throw' expr ';' | 'assert' expr (':' expr)? ';' | NAME ':' stmt
  | 'synchronized' '(' expr ')' block | switch
  | 'try' ('(' resource (';' resource)* ';'? ')' block ('catch' '(' mod* type ('BAR' type)* NAME ')' block)* ('finally' block)?
      | block (('catch' '(' mod* type ('BAR' type)* NAME ')' block)+ ('finally' block)? | 'finally' block)) ;;
resource := mod* type NAME '=' expr | expr ;;
switch := 'switch' '(' expr ')' '{' ((label ':')+ stmt* | label '->' (expr ';' | block | 'throw' expr ';'))* '}' ;;
label := 'case' caseitem (',' caseitem)* ('when' expr)? | 'default' ;;
caseitem := expr | pattern | 'default' ;;
pattern := mod* type (NAME | '(' (pattern (',' pattern)*)? ')' NAME?) ;;
args := expr (',' expr)* ;;
expr := unary (('BIN' | '=' | 'ASGN' | '*' | '+' | '-' | 'AMP' | 'BAR' | '<' | '>' ('>' '>'?)? '='? | '?' expr ':') unary | 'instanceof' (type | pattern))* ;;
unary := ('INC' | '+' | '-' | '!' | '~' | '(' type ('AMP' type)* ')' | arrow)* (postfix | arrow block) ;;
arrow := (NAME | '(' (params | NAME (',' NAME)*)? ')') '->' ;;
postfix := primary trailer* 'INC'? ;;
primary := NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | NAME | NAME targs | '(' expr ')' | switch
  | 'new' anno* ('PRIM' | cls) ('(' args? ')' classbody? | ('[' expr ']')+ dims | ('[' ']')+ '{' (init (',' init)* ','?)? '}')
  | ('PRIM' | 'void' | cls) dims '.' 'class' | ('PRIM' | cls) dims '::' 'new' | 'PRIM' dims '::' NAME | cls dims '::' targs? NAME
LISTS>  | '[' args? ']'
  ;;
trailer := '.' (targs? NAME | 'this' | 'super' | 'new' NAME targs? '(' args? ')' classbody?) | '(' args? ')' | '[' expr ']' | '::' targs? (NAME | 'new') ;;
"""

RUST = r"""
file := inner* item* ;;
inner := '#' '!' '[' tts ']' ;;
attr := '#' '[' tts ']' ;;
tts := tt* ;;
tt := ANY | '(' tts ')' | '[' tts ']' | '{' tts '}' ;;
vis := 'pub' ('(' tts ')')? ;;
item := attr* vis? (fn | 'struct' NAME generics? (where? '{' fields '}' | '(' tfields ')' where? ';' | where? ';') | 'union' NAME generics? where? '{' fields '}'
  | 'enum' NAME generics? where? '{' (variant (',' variant)* ','?)? '}'
  | 'unsafe'? 'auto'? 'trait' NAME generics? (':' bounds?)? where? '{' inner* assoc* '}'
  | 'default'? 'unsafe'? 'impl' generics? 'const'? ('!'? type 'for')? type where? '{' inner* assoc* '}'
  | 'unsafe'? 'mod' NAME (';' | '{' inner* item* '}') | 'use' usetree ';' | 'extern' 'crate' (NAME | 'self') ('as' NAME)? ';'
  | ('const' | 'static') 'mut'? NAME ':' type ('=' expr)? ';' | 'type' NAME generics? (':' bounds?)? where? ('=' type)? where? ';'
  | 'unsafe'? 'extern' STR? '{' inner* assoc* '}' | path '!' NAME? ('{' tts '}' | ('(' tts ')' | '[' tts ']') ';')) ;;
assoc := attr* vis? (fn | 'default'? ('const' | 'static') 'mut'? NAME ':' type ('=' expr)? ';' | 'default'? 'type' NAME generics? (':' bounds?)? where? ('=' type)? where? ';' | path '!' ('{' tts '}' | ('(' tts ')' | '[' tts ']') ';')) ;;
fn := ('const' | 'async' | 'unsafe' | 'default' | 'safe' | 'extern' STR?)* 'fn' NAME generics? '(' (param (',' param)* ','?)? ')' ('->' type)? where? (block | ';') ;;
param := attr* (('AMP' LIFE?)? 'mut'? 'self' (':' type)? | pat ':' type | type | '...') ;;
fields := (field (',' field)* ','?)? ;;
field := attr* vis? NAME ':' type ('=' expr)? ;;
tfields := (attr* vis? type (',' attr* vis? type)* ','?)? ;;
variant := attr* vis? NAME ('{' fields '}' | '(' tfields ')')? ('=' expr)? ;;
usetree := ('::'? useseg ('::' useseg)*  ('as' NAME)?) | (('::'? (useseg '::')*) ('*' | '{' (usetree (',' usetree)* ','?)? '}')) ;;
useseg := NAME | 'self' | 'super' | 'crate' | 'Self' ;;
generics := '<' (gparam (',' gparam)* ','?)? '>' ;;
gparam := attr* (LIFE (':' lifes?)? | NAME (':' bounds?)? ('=' type)? | 'const' NAME ':' type ('=' (block | '-'? NUM | NAME | 'true' | 'false'))?) ;;
lifes := LIFE ('+' LIFE)* '+'? ;;
where := 'where' (wpred (',' wpred)* ','?)? ;;
wpred := LIFE ':' lifes? | ('for' generics)? type ':' bounds? ;;
bounds := bound ('+' bound)* '+'? ;;
bound := LIFE | ('?' | '~' 'const' | 'const' | 'async')* ('for' generics)? path | '(' bound ')' | 'use' generics ;;
type := '(' (type (',' type)* ','?)? ')' | '!' | '*' ('const' | 'mut') type | 'AMP' LIFE? 'mut'? type | 'AMP2' LIFE? 'mut'? type | '[' type (';' expr)? ']' | '_'
  | ('for' generics)? 'unsafe'? ('extern' STR?)? 'fn' '(' (attr* (NAME ':' | '_' ':')? (type | '...') (',' attr* (NAME ':' | '_' ':')? (type | '...'))* ','?)? ')' ('->' type)?
  | ('impl' | 'dyn') bounds | path '!' ('(' tts ')' | '[' tts ']' | '{' tts '}') | ('for' generics)? path ('+' bounds)? | qpath ;;
path := '::'? seg ('::' seg)* ;;
seg := (NAME | 'self' | 'super' | 'crate' | 'Self') ('::'? gargs | '::'? '(' (type (',' type)* ','?)? ')' ('->' type)?)? ;;
qpath := '<' type ('as' path)? '>' ('::' seg)+ ;;
gargs := '<' (garg (',' garg)* ','?)? '>' ;;
garg := LIFE | type | NAME gargs? ('=' type | ':' bounds) | block | '-'? NUM | STR | 'true' | 'false' ;;
block := '{' stmts '}' ;;
stmts := inner* (stmt)* expr? ;;
stmt := ';' | item | attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | expr ';' | attr* blocklike ;;
blocklike := (LIFE ':')? ('unsafe' block | 'async' 'move'? block | 'const' block | block | 'if' expr block ('else' 'if' expr block)* ('else' block)? | 'match' expr '{' inner* (arm)* '}' | 'while' expr block | 'loop' block | 'for' pat 'in' expr block)
  | path '!' '{' tts '}' ;;
arm := attr* pat ('if' expr)? '=>' (expr ',' | blocklike ','? | expr) ;;
pat := 'BAR'? pat1 ('BAR' pat1)* ;;
pat1 := '_' | '..' | 'ref'? 'mut'? NAME ('@' pat1)? | ('AMP' | 'AMP2') 'mut'? pat1 | '(' (pat (',' pat)* ','?)? ')' | '[' (pat (',' pat)* ','?)? ']'
  | patlit (('..=' | '..' | '...') patlit?)? | ('..=' | '..') patlit | (path | qpath) ('(' (pat (',' pat)* ','?)? ')' | '{' (fpat (',' fpat)* ','?)? '}')? | path '!' ('(' tts ')' | '[' tts ']' | '{' tts '}') | 'box' pat1 | 'const' block ;;
patlit := '-'? NUM | STR | 'true' | 'false' | path | qpath ;;
fpat := attr* ('..' | ('ref'? 'mut'? NAME) | (NAME | NUM) ':' pat) ;;
expr := attr* (('..' | '..=') (operand chain*)? | operand chain* ('..' | '..=')?) ;;
chain := ('BIN' | '*' | '+' | '-' | 'AMP' | 'AMP2' | 'BAR' | '<' | '>' '>'? '='? | '=' | 'ASGN' | '..' | '..=') operand | 'as' type ;;
operand := ('-' | '*' | '!' | ('AMP' | 'AMP2') ('raw'? ('mut' | 'const'))? | closure)* postfix ;;
closure := ('for' generics)? 'const'? 'static'? 'async'? 'move'? ('BAR' (cparam (',' cparam)* ','?)? 'BAR' | 'BAR2') ('->' type)? ;;
cparam := attr* pat1 (':' type)? ;;
postfix := primary ('?' | '.' ('await' | NUM | seg) | '(' (expr (',' expr)* ','?)? ')' | '[' expr ']')* ;;
primary := NUM | STR | 'true' | 'false' | (path | qpath) ('{' (finit (',' finit)* ','?)? ('..' expr?)? '}')? | '_' | path '!' ('(' tts ')' | '[' tts ']' | '{' tts '}')
  | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (',' expr)* ','? | expr ';' expr)? ']' | blocklike
  | 'let' pat '=' expr | ('return' | 'break' LIFE?) expr? | 'continue' LIFE? | 'yield' expr? ;;
finit := attr* (NAME | (NAME | NUM) ':' expr) ;;
"""


#: Marks of lines: TypeScript, JavaScript, scripts, modules, modules in TypeScript, bracketed lists in Java, newer Python versions.
MARKS = ("TS", "JS", "SCRIPT", "MODULE", "TSM", "LISTS", "P310", "P312")


def python(*flags: str) -> str:
    """The Python grammar; without flags that of version 3.8."""
    text = variant(PYTHON, *flags).replace("'BIN'", "('BIN' | '|')")
    return text if "P312" in flags else text.replace(" tparams?", "").replace("'except' '*'?", "'except'")


def variant(text: str, *flags: str) -> str:
    """The grammar text with the marked lines of ``flags`` only."""
    out = []
    for line in text.splitlines():
        mark, _, rest = line.partition("> ")
        if mark in MARKS:
            if mark in flags:
                out.append(rest)
        else:
            out.append(line)
    return "\n".join(out)

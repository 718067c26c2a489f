"""Grammars of the supported languages, in the notation of ``gll``. Written from the languages' public references.

They accept every valid file of the language and, where the rest is not a matter of phrase structure (names that
are declared twice, where ``break`` or ``await`` may stand), somewhat more.
"""

from __future__ import annotations

import re
from functools import lru_cache

from spanlode.llm.gll import Grammar

GO = """
File = ';'? 'package' ID ';' (Import ';')* (Top ';')*
Import = 'import' (Spec | p:Specs)
Spec = (ID | '.')? STR
Specs = (Spec (';' Spec)* ';'?)?
Top = 'func' p:Params? ID s:TParams? Signature b:Stmts? | Decl
Decl = 'const' (ConstSpec | p:ConstSpecs) | 'type' (TypeSpec | p:TypeSpecs) | 'var' (VarSpec | p:VarSpecs)
ConstSpecs = (ConstSpec (';' ConstSpec)* ';'?)?
ConstSpec = Ids (Type? '=' Exprs)?
VarSpecs = (VarSpec (';' VarSpec)* ';'?)?
VarSpec = Ids (Type ('=' Exprs)? | '=' Exprs)
TypeSpecs = (TypeSpec (';' TypeSpec)* ';'?)?
TypeSpec = ID s:TParams? '='? Type
TParams = Ids Constraint (',' Ids Constraint)* ','?
Constraint = '~'? Type ('|' '~'? Type)*
Ids = ID (',' ID)*
Signature = p:Params (p:Params | Type)?
Params = (Param (',' Param)* ','?)?
Param = ID? '...'? Type
Type = '*' Type | TypeName | s:Length Type | 'map' s:Type Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Signature | 'struct' b:Fields | 'interface' b:Elems | p:Type
Types = Type (',' Type)* ','?
TypeName = ID ('.' ID)? s:Types?
Length = Expr? | '...'
Fields = (Field (';' Field)* ';'?)?
Field = (Ids Type | '*'? TypeName) STR?
Elems = (Elem (';' Elem)* ';'?)?
Elem = ID Signature | Constraint
Stmts = Stmt? (';' Stmt?)*
Stmt = Decl | Simple | 'return' Exprs? | ('break' | 'continue') ID? | 'goto' ID | 'fallthrough' | ('defer' | 'go') Expr | b:Stmts | If | 'switch' (HSimple? ';')? HSimple? b:Cases | 'select' b:Comms | 'for' ForHead? b:Stmts | ID ':' Stmt?
Simple = Exprs (Assign Exprs)? | Expr ('++' | '--') | Expr '<-' Expr
Assign = '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
HSimple = HExprs (Assign HExprs)? | HExpr ('++' | '--') | HExpr '<-' HExpr
If = 'if' (HSimple? ';')? HSimple b:Stmts ('else' (If | b:Stmts) | @noelse)
Cases = (('case' (Expr | Type) (',' (Expr | Type))* | 'default') ':' Stmts)*
Comms = (('case' Simple | 'default') ':' Stmts)*
ForHead = HSimple | HSimple? ';' HSimple? ';' HSimple? | (HExprs ('=' | ':='))? 'range' HExpr
HExprs = HExpr (',' HExpr)*
HExpr = HUnary (BinOp HUnary)*
HUnary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* Operand HSuffix*
Exprs = Expr (',' Expr)*
Expr = Unary (BinOp Unary)*
BinOp = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
Unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* Primary
Primary = Operand Suffix*
Operand = NUM | STR | CHAR | ID | p:ExprOrType | 'func' Signature b:Stmts | LitType (b:Lit | p:Args)
LitType = s:Length Type | 'map' s:Type Type | 'struct' b:Fields | 'chan' Type | 'interface' b:Elems | 'func' Signature
ExprOrType = Expr | Type
Suffix = HSuffix | b:Lit
HSuffix = '.' ID | '.' p:Asserted | s:Index | p:Args
Asserted = Type | 'type'
Index = Expr | Types | Expr? ':' Expr? (':' Expr)?
Args = ((Expr | Type) (',' (Expr | Type))* '...'? ','?)?
Lit = (Elt (',' Elt)* ','?)?
Elt = (Value ':')? Value
Value = Expr | b:Lit
"""

JAVA = """
File = (Note* 'package' Name ';')? (Import | ';')* (Mod* TypeDecl | ';' | Note* 'open'? 'module' Name b:ANY)*
Import = 'import' 'static'? Name ('.' '*')? ';'
Name = ID ('.' ID)*
Mod = 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' | Note
Note = '@' Name p:NoteArgs?
NoteArgs = NoteValue | (ID '=' NoteValue (',' ID '=' NoteValue)*)?
NoteValue = Ternary | Note | b:NoteValues
NoteValues = (NoteValue (',' NoteValue)*)? ','?
TypeDecl = 'class' ID TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? b:Members | 'interface' ID TParams? ('extends' Types)? ('permits' Types)? b:Members | 'enum' ID ('implements' Types)? b:Enums | 'record' ID TParams? p:Formals ('implements' Types)? b:Members | '@' 'interface' ID b:Members
Members = Member*
Member = ';' | 'static'? b:Stmts | Mod* (TypeDecl | TParams? (Type | 'void') ID p:Formals Dims? ('throws' Types)? (b:Stmts | ('default' NoteValue)? ';') | Type Vars ';' | TParams? ID p:Formals ('throws' Types)? b:Stmts | ID b:Stmts)
Enums = (Enum (',' Enum)*)? ','? (';' Member*)?
Enum = Note* ID p:Args? b:Members?
TParams = '<' TParam (',' TParam)* '>'
TParam = Note* ID ('extends' Type ('&' Type)*)?
Type = Note* (Prim | ClassType) Dims?
Types = Type (',' Type)*
Prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'
Dims = (Note* s:EMPTY)+
ClassType = ID TArgs? ('.' Note* ID TArgs?)*
TArgs = '<' (TArg (',' TArg)*)? '>'
TArg = Type | Note* '?' (('extends' | 'super') Type)?
Formals = (Formal (',' Formal)*)?
Formal = ('final' | Note)* Type '...'? (ID '.')? ('this' | ID Dims?)
Vars = Var (',' Var)*
Var = ID Dims? ('=' Init)?
Init = Expr | b:Inits
Inits = (Init (',' Init)*)? ','?
Stmts = BlockStmt*
BlockStmt = ('final' | Note)* Type Vars ';' | Mod* TypeDecl | Stmt
Stmt = b:Stmts | ';' | Act ';' | 'if' p:Expr Stmt ('else' Stmt | @noelse) | 'while' p:Expr Stmt | 'do' Stmt 'while' p:Expr ';' | 'for' p:ForHead Stmt | 'switch' p:Expr b:Switch | 'return' Expr? ';' | ('break' | 'continue') ID? ';' | 'throw' Expr ';' | Try | 'synchronized' p:Expr b:Stmts | 'assert' Expr (':' Expr)? ';' | 'yield' Expr ';' | ID ':' Stmt
Act = Postfix AssignOp Expr | ('++' | '--') Unary | Primary ('++' | '--') | Base Suffix* p:Args | New Suffix*
Try = 'try' (b:Stmts (Catch+ Finally? | Finally) | p:Resources b:Stmts Catch* Finally?)
Catch = 'catch' p:Caught b:Stmts
Caught = ('final' | Note)* ClassType ('|' ClassType)* ID
Finally = 'finally' b:Stmts
Resources = Resource (';' Resource)* ';'?
Resource = ('final' | Note)* Type ID '=' Expr | Postfix
ForHead = (('final' | Note)* Type Vars | Act (',' Act)*)? ';' Expr? ';' (Act (',' Act)*)? | ('final' | Note)* Type ID ':' Expr
Switch = (Label ':' BlockStmt*)* | (Label '->' (Expr ';' | b:Stmts | 'throw' Expr ';'))*
Label = 'case' CaseValue (',' CaseValue)* | 'default'
CaseValue = Ternary | 'default' | 'null'
Expr = Lambda | Ternary @noassign | Postfix AssignOp Expr
Lambda = (ID | p:LambdaParams) '->' (Expr | b:Stmts)
LambdaParams = Formals | ID (',' ID)*
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
Ternary = Binary ('?' Expr ':' (Lambda | Ternary) | @noquery)
Binary = Unary (BinOp Unary | 'instanceof' 'final'? Type ID?)*
BinOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%'
Unary = ('+' | '-' | '!' | '~' | '++' | '--') Unary | p:CastType (Unary | Lambda) | Postfix
CastType = Type ('&' Type)*
Postfix = Primary ('++' | '--')*
Primary = Base Suffix*
Base = NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | ID | p:Expr | New | 'switch' p:Expr b:Switch | Type '.' 'class' | 'void' '.' 'class' | Type '::' TArgs? (ID | 'new')
New = 'new' TArgs? Note* (ClassType p:Args b:Members? | (Prim | ClassType) (s:Expr+ s:EMPTY* | Dims b:Inits))
Suffix = '.' TArgs? ID | '.' New | '.' ('this' | 'class' | 'super') | s:Expr | p:Args | '::' TArgs? (ID | 'new')
Args = (Expr (',' Expr)*)?
"""

RUST = """
File = Items
Items = ('#' '!' s:ANY)* Item*
Attr = '#' s:ANY
Item = Attr* (('pub' p:ANY?)? Kind | Macro)
Macro = Path '!' ID? (b:ANY | p:ANY ';' | s:ANY ';')
Kind = 'use' UseTree ';' | 'mod' ID (';' | b:Items) | 'extern' 'crate' (ID | 'self') ('as' (ID | '_'))? ';' | Fn | Alias | 'struct' ID Gen? (Where? b:Fields | p:Tuple Where? ';' | Where? ';') | 'union' ID Gen? Where? b:Fields | 'enum' ID Gen? Where? b:Variants | Const | 'unsafe'? 'auto'? 'trait' ID Gen? (':' Bounds?)? Where? b:Items | 'unsafe'? 'impl' Gen? 'const'? '!'? Type ('for' Type)? Where? b:Items | 'unsafe'? 'extern' STR? b:Items
Alias = 'type' ID Gen? (':' Bounds?)? Where? ('=' Type Where?)? ';'
Const = 'default'? ('const' (ID | '_') | 'static' 'mut'? ID) (':' Type)? ('=' Expr)? ';'
UseTree = '::'? (Step '::')* (Step ('as' (ID | '_'))? | '*' | b:UseTrees)
Step = ID | 'self' | 'super' | 'crate'
UseTrees = (UseTree (',' UseTree)* ','?)?
Fn = ('default' | 'const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' ID Gen? p:FnParams ('->' Type)? Where? (b:Block | ';')
FnParams = (FnParam (',' FnParam)* ','?)?
FnParam = Attr* (('&' LIFE?)? 'mut'? 'self' (':' Type)? | Pattern ':' Type | Type | '...')
Gen = '<' (GenParam (',' GenParam)* ','?)? '>'
GenParam = Attr* (LIFE (':' (LIFE ('+' LIFE)*)?)? | ID (':' Bounds?)? ('=' Type)? | 'const' ID ':' Type ('=' (b:Block | '-'? NUM | ID | 'true' | 'false'))?)
Bounds = Bound ('+' Bound)* '+'?
Bound = LIFE | ('?' | '~' 'const')? ForLife? Path | p:Bound
ForLife = 'for' Gen
Where = 'where' (Pred (',' Pred)* ','?)?
Pred = LIFE ':' (LIFE ('+' LIFE)*)? | ForLife? Type ':' Bounds?
Fields = (FieldDef (',' FieldDef)* ','?)?
FieldDef = Attr* ('pub' p:ANY?)? ID ':' Type
Tuple = (TupleDef (',' TupleDef)* ','?)?
TupleDef = Attr* ('pub' p:ANY?)? Type
Variants = (Variant (',' Variant)* ','?)?
Variant = Attr* ('pub' p:ANY?)? ID (b:Fields | p:Tuple)? ('=' Expr)?
Type = ('&' | '&&') LIFE? 'mut'? Type | '*' ('const' | 'mut') Type | p:Types | s:ArrayType | ('impl' | 'dyn') Bounds | Path ('!' (p:ANY | s:ANY | b:ANY))? | QPath | '!' | '_' | ForLife? ('unsafe' | 'extern' STR?)* 'fn' p:FnTypeParams ('->' Type)? | ForLife Path
FnTypeParams = (FnTypeParam (',' FnTypeParam)* ','?)?
FnTypeParam = ((ID | '_') ':')? Type | '...'
Types = (Type (',' Type)* ','?)?
ArrayType = Type (';' Expr)?
Path = '::'? Seg ('::' Seg)*
Seg = (ID | 'self' | 'Self' | 'super' | 'crate') ('::'? GenArgs | p:Types ('->' Type)?)?
QPath = '<' Type ('as' Path)? '>' ('::' Seg)+
GenArgs = '<' (GenArg (',' GenArg)* ','?)? '>'
GenArg = LIFE | Type | ID GenArgs? ('=' Type | ':' Bounds) | b:Block | '-'? NUM | STR | CHAR | 'true' | 'false'
Pattern = '|'? Pat ('|' Pat)*
Pat = '_' | '..' | ('ref' | 'mut')* ID ('@' Pat)? | ('&' | '&&') 'mut'? Pat | PatEnd (('..=' | '...' | '..') PatEnd?)? | ('..=' | '..') PatEnd | PatPath (b:PatFields | p:Patterns)? | p:Patterns | s:Patterns | PatPath '!' (p:ANY | s:ANY | b:ANY) | 'box' Pat
PatPath = ('::'? PSeg ('::' PSeg)*) | QPath
PSeg = (ID | 'self' | 'Self' | 'super' | 'crate') ('::' GenArgs)?
PatEnd = '-'? NUM | STR | CHAR | 'true' | 'false' | PatPath | 'const' b:Block
Patterns = (Pattern (',' Pattern)* ','?)?
PatFields = (PatField (',' PatField)* ','?)?
PatField = Attr* (('ref' | 'mut')* ID | (ID | NUM) ':' Pattern | '..')
Block = ('#' '!' s:ANY)* Stmt* (Attr* Expr)?
Stmt = ';' | Item | Attr* 'let' Pattern (':' Type)? ('=' Expr ('else' b:Block)?)? ';' | Attr* Expr ';' | Attr* Blocky
Blocky = (LIFE ':')? (If | 'match' Expr b:Arms | 'while' Cond b:Block | 'loop' b:Block | 'for' Pattern 'in' Expr b:Block | b:Block) | ('unsafe' | 'async' 'move'? | 'const') b:Block
If = 'if' Cond b:Block ('else' (If | b:Block) | @noelse)
Cond = LetCond ('&&' LetCond)* | Expr
LetCond = 'let' Pattern '=' Expr | Expr
Arms = ('#' '!' s:ANY)* (Arm ',' | Attr* Pattern ('if' Cond)? '=>' Blocky ','?)* Arm?
Arm = Attr* Pattern ('if' Cond)? '=>' Expr
Expr = Range | ('return' | 'break' LIFE? | 'yield') Expr? | 'continue' LIFE? | Closure
Range = Bin (('..' | '..=') Bin?)? | ('..' | '..=') Bin?
Closure = ('for' Gen)? 'static'? 'async'? 'move'? ('||' | '|' ClosureParams '|') (Expr | '->' Type b:Block)
ClosureParams = (ClosureParam (',' ClosureParam)* ','?)?
ClosureParam = Attr* Pat (':' Type)?
Bin = Cmp (JoinOp (Cmp | Jump))*
Cmp = Arith (CmpOp (Arith | Jump))?
Arith = Unary (ArithOp (Unary | Jump) | 'as' Type)*
Jump = ('return' | 'break' LIFE?) Expr? | 'continue' LIFE? | Closure
JoinOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>=' | '||' | '&&'
CmpOp = '==' | '!=' | '<' | '>' | '<=' | '>='
ArithOp = '|' | '^' | '&' | '<<' | '>' '>' | '+' | '-' | '*' | '/' | '%'
Unary = ('-' | '!' | '*' | ('&' | '&&') ('raw' ('const' | 'mut'))? 'mut'?)* Postfix
Postfix = Primary Suffix*
Primary = NUM | STR | CHAR | 'true' | 'false' | ExprPath (b:StructLit)? | ExprPath '!' (p:ANY | s:ANY | b:ANY) | p:Exprs | s:ArrayLit | Blocky | '_'
ExprPath = '::'? PSeg ('::' PSeg)* | QPath
Suffix = '.' ID ('::' GenArgs)? | '.' NUM | '.' 'await' | p:Exprs | s:Expr | '?'
Exprs = (Attr* Expr (',' Attr* Expr)* ','?)?
ArrayLit = (Expr (';' Expr | (',' Expr)* ','?))?
StructLit = (FieldInit (',' FieldInit)* ','?)? ('..' Expr?)?
FieldInit = Attr* ((ID | NUM) ':' Expr | ID)
"""

SCRIPT = """
Script = TStmt*
Module = (Import | Export | TStmt)*
EOS = ';' | @nl
Stmts = Stmt*
Stmt = b:Stmts | ';' | Decl | @nobrace @noword Expr EOS | 'if' p:Expr Stmt ('else' Stmt | @noelse) | 'for' 'await'? p:ForHead Stmt | 'while' p:Expr Stmt | 'do' Stmt 'while' p:Expr ';'? | ('continue' | 'break') ID? EOS | 'return' Expr? EOS | 'throw' Expr EOS | Try | 'switch' p:Expr b:Cases | ID ':' Stmt | 'debugger' EOS | 'with' p:Expr Stmt
Decl = ('var' | 'let') Bind (',' Bind)* EOS | 'const' Const (',' Const)* EOS | Func | Class | TsDecl
Bind = ID TsBang? Ann? ('=' Assign)? | Pat Ann? '=' Assign
Const = Target Ann? '=' Assign
Target = ID | Pat
Pat = s:ArrPat | b:ObjPat
ArrPat = Elem? (',' Elem?)*
Elem = '...' Target | Target Ann? ('=' Assign)?
ObjPat = (PatProp (',' PatProp)* ','?)?
PatProp = '...' Target | Key ':' Target ('=' Assign)? | ID ('=' Assign)?
Func = 'async'? 'function' '*'? ID TParams? p:Params RAnn? (b:Stmts | TsEnd)
Params = (Param (',' Param)* ','?)?
Param = Deco* TsMod* ('...' Target Ann? | (Target | 'this') '?'? Ann? ('=' Assign)?)
Class = Deco* TsAbstract? 'class' ID? TParams? ('extends' Left TArgs?)? Implements? b:Members
Deco = '@' (ID ('.' NAME)* p:Args? | p:Expr)
Members = (Member | ';')*
Member = 'static' b:TStmts | Deco* ('static' | TsMod)* ('accessor'? Key TsOpt? Ann? ('=' Assign)? EOS | ('async'? '*'? | 'get' | 'set') Key TsOpt? TParams? p:Params RAnn? (b:Stmts | TsEnd) | TsIndex)
Key = NAME | STR | NUM | s:Assign | PRIVATE
ForHead = (('var' | 'let' | 'const') ForVar (',' ForVar)* | Expr)? ';' Expr? ';' Expr? | (('var' | 'let' | 'const') Target | Left) ('in' Expr | 'of' Assign)
ForVar = Target Ann? ('=' Assign)?
Try = 'try' b:Stmts (Catch ('finally' b:Stmts)? | 'finally' b:Stmts)
Catch = 'catch' p:Caught? b:Stmts
Caught = Target Ann?
Cases = (('case' Expr | 'default') ':' Stmt*)*
Expr = Assign (',' Assign)*
Assign = Cond @noassign | Left AssignOp Assign | 'async'? (ID | TParams? p:Params RAnn?) '=>' (@nobrace Assign | b:Stmts) | 'yield' '*'? Assign?
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
Cond = Bin ('?' Assign ':' Assign | @noquery)
Bin = (PRIVATE 'in')? Unary (BinOp Unary | TsAs)*
BinOp = '??' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | '**'
Unary = ('delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | 'await') Unary | ('++' | '--') Unary | Left ('++' | '--')? | TsCast
Left = Prim Suffix*
Suffix = '.' (NAME | PRIVATE) | '?.' (NAME | PRIVATE | s:Expr | TArgs? p:Args | TEMPLATE) | s:Expr | p:Args | TEMPLATE | TsSuffix
Args = (('...'? Assign) (',' '...'? Assign)* ','?)?
Prim = 'this' | 'super' | 'null' | 'true' | 'false' | ID | NUM | STR | REGEX | TEMPLATE | ELEMENT | s:ArrLit | b:ObjLit | p:Expr | 'async'? 'function' '*'? ID? TParams? p:Params RAnn? b:Stmts | Class | 'new' Prim | 'new' '.' 'target' | 'import' (p:Args | '.' 'meta')
ArrLit = ('...'? Assign)? (',' ('...'? Assign)?)*
Slot = ('...'? Expr)?
ObjLit = (Prop (',' Prop)* ','?)?
Prop = '...' Assign | Key ':' Assign | ID ('=' Assign)? | ('async'? '*'? | 'get' | 'set') Key TParams? p:Params RAnn? b:Stmts
Import = 'import' (STR | TsType? Clause 'from' STR) ('with' b:ObjLit)? EOS | TsImport
Clause = ID (',' (b:ImpSpecs | '*' 'as' ID))? | b:ImpSpecs | '*' 'as' ID
ImpSpecs = (ImpSpec (',' ImpSpec)* ','?)?
ImpSpec = TsType? ((NAME | STR) 'as' ID | ID)
Export = 'export' ('default' ('async'? 'function' '*'? ID? TParams? p:Params RAnn? (b:Stmts | TsEnd) | Class | TsDecl | @noword Assign EOS) | Decl | TsType? (b:ExpSpecs ('from' STR ('with' b:ObjLit)?)? | '*' ('as' (NAME | STR))? 'from' STR) EOS | TsExport) | Deco+ 'export' 'default'? Class
ExpSpecs = (ExpSpec (',' ExpSpec)* ','?)?
ExpSpec = TsType? (NAME | STR) ('as' (NAME | STR))?
"""



def _without_return(grammar: str) -> str:
    """The rules of statements once more, named with a T, for places outside of functions."""
    out = []
    for line in grammar.splitlines():
        name, _, body = line.partition(" = ")
        if name in ("Stmt", "Stmts", "Try", "Catch", "Cases"):
            out.append(f"T{name} = " + re.sub(r"\b(Stmts?|Try|Catch|Cases)\b", r"T\1", body.replace("'return' Expr? EOS | ", "")))
    return "\n".join(out) + "\n"


SCRIPT += _without_return(SCRIPT)

PLAIN = "".join(f"{n} = NEVER\n" for n in "Ann RAnn TsBang TsEnd TsMod TsAbstract Implements TsOpt TsIndex TsAs TsCast TsSuffix TsType TsImport TsExport TsDecl TParams TArgs".split())

TYPED = """
Ann = ':' Type
RAnn = ':' Type
TsBang = '!'
TsEnd = EOS
TsMod = 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'
TsAbstract = 'abstract'
Implements = 'implements' Types
TsOpt = '?' | '!'
TsIndex = s:IndexKey Ann EOS
IndexKey = ID Ann
TsAs = 'as' (Type | 'const') | 'satisfies' Type
TsCast = '<' Type '>' Unary
TsSuffix = '!' | TArgs p:Args | TArgs TEMPLATE
TsType = 'type'
TsImport = 'import' 'type'? ID '=' (ID ('.' ID)* | 'require' p:Args) EOS
TsExport = '=' Expr EOS | 'as' 'namespace' ID EOS | 'import' ID '=' ID ('.' ID)* EOS
TsDecl = 'interface' ID TParams? ('extends' Types)? b:TypeMembers | 'type' ID TParams? '=' Type EOS | 'const'? 'enum' ID b:Enum | 'declare' (Decl | Ambient | 'global' b:Ambients) | ('namespace' | 'module') (ID ('.' ID)* | STR) (b:Ambients | EOS)
Ambient = ('var' | 'let' | 'const') AmbientVar (',' AmbientVar)* EOS
AmbientVar = ID Ann?
Ambients = (Import | Export | TStmt | 'export'? Ambient)*
Enum = (EnumItem (',' EnumItem)* ','?)?
EnumItem = (NAME | STR | s:Assign) ('=' Assign)?
TParams = '<' TParam (',' TParam)* ','? '>'
TParam = ('const' | 'in' | 'out')* ID ('extends' Type)? ('=' Type)?
TArgs = '<' Type (',' Type)* '>'
Types = HeldType (',' HeldType)*
HeldType = ID ('.' NAME)* TArgs? p:Args?
Type = Union ('extends' Union '?' Type ':' Type)? | 'abstract'? 'new'? TParams? p:Params '=>' Type | 'asserts'? (ID | 'this') 'is' Type | 'asserts' (ID | 'this')
Union = '|'? Inter ('|' Inter)*
Inter = '&'? TOp ('&' TOp)*
TOp = ('keyof' | 'readonly' | 'unique') TOp | 'infer' ID ('extends' Union)? | TPrim (s:EMPTY | s:Type)*
TPrim = ID ('.' NAME)* TArgs? | STR | '-'? NUM | TEMPLATE | 'true' | 'false' | 'null' | 'void' | 'this' | 'typeof' (ID | 'this' | 'import' p:Args) ('.' NAME)* TArgs? | p:Type | s:TupleItems | b:TypeMembers | b:Mapped | 'import' p:Args ('.' NAME)* TArgs?
TupleItems = (TupleItem (',' TupleItem)* ','?)?
TupleItem = '...'? (NAME '?'? ':')? Type '?'?
TypeMembers = (TypeMember (';' | ',' | @nl))*
TypeMember = ('readonly' | '+' 'readonly' | '-' 'readonly')? (Key '?'? Ann? | ('get' | 'set')? Key '?'? TParams? p:Params RAnn? | 'new'? TParams? p:Params RAnn? | s:IndexKey Ann)
Mapped = (('+' | '-')? 'readonly')? s:MappedKey (('+' | '-')? '?')? Ann? (';' | ',')?
MappedKey = ID 'in' Type ('as' Type)?
"""

PYTHON = """
File = Stmt*
Block = Stmt+
Stmt = Line | Compound
Line = Small (';' Small)* ';'? NEWLINE
Suite = Line | NEWLINE i:Block
Small = StarExprs | Target AugOp (Yield | StarExprs) | Target ':' Expr ('=' (Yield | StarExprs))? | (StarTargets '=')+ (Yield | StarExprs) | Yield | 'return' StarExprs? | 'import' Dotted ('as' ID)? (',' Dotted ('as' ID)?)* | 'from' ('.' | '...')* Dotted? 'import' ('*' | Names | p:NamesEnd) | 'raise' (Expr ('from' Expr)?)? | 'pass' | 'break' | 'continue' | 'del' StarTargets | ('global' | 'nonlocal') ID (',' ID)* | 'assert' Expr (',' Expr)? | 'type' ID s:TParams? '=' Expr
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Dotted = ID ('.' ID)*
Names = ID ('as' ID)? (',' ID ('as' ID)?)*
NamesEnd = Names ','?
Target = ID | Primary ('.' ID | s:Slices) | p:Target
StarTargets = StarTarget (',' StarTarget)* ','?
StarTarget = '*'? (ID | Primary ('.' ID | s:Slices) | p:TargetList | s:TargetList)
TargetList = StarTargets?
Compound = 'if' Named ':' Suite ('elif' Named ':' Suite)* Else? | 'while' Named ':' Suite Else? | 'async'? 'for' StarTargets 'in' StarExprs ':' Suite Else? | 'try' ':' Suite (('except' '*'? (Exprs ('as' ID)?)? ':' Suite)+ Else? ('finally' ':' Suite)? | 'finally' ':' Suite) | 'async'? 'with' (WithItem (',' WithItem)* | p:WithItems) ':' Suite | Decorated | 'match' StarExprs ':' NEWLINE i:Cases
Else = 'else' ':' Suite
WithItem = Expr ('as' StarTarget)?
WithItems = WithItem (',' WithItem)* ','?
Decorated = ('@' Named NEWLINE)* ('async'? 'def' ID s:TParams? p:Params ('->' Expr)? ':' Suite | 'class' ID s:TParams? p:Args? ':' Suite)
TParams = TParam (',' TParam)* ','?
TParam = ('*' | '**')? ID (':' Expr)? ('=' StarExpr)?
Params = (Pos (',' Star)? ','? | Star ','?)?
Pos = Bares (',' '/')? (',' Defaults)? | Bares ',' '/' ',' Bares (',' Defaults)? | (Bares ',')? Defaults (',' '/' (',' Defaults)?)?
Bares = Bare (',' Bare)*
Defaults = Default (',' Default)*
Bare = ID (':' Expr)?
Default = ID (':' Expr)? '=' Expr
Star = '*' ID (':' StarExpr)? (',' (Bare | Default))* (',' Stars)? | '*' (',' (Bare | Default))+ (',' Stars)? | Stars
Stars = '**' ID (':' Expr)?
Cases = ('case' Patterns ('if' Named)? ':' Suite)+
Patterns = OpenPattern (',' OpenPattern)* ','?
OpenPattern = '*' ID | Pattern
Pattern = OrPattern ('as' ID)?
OrPattern = ClosedPattern ('|' ClosedPattern)*
ClosedPattern = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | Dotted p:PatternArgs? | p:PatternList | s:PatternList | b:PatternMap
PatternList = Patterns?
PatternArgs = ((ID '=')? Pattern (',' (ID '=')? Pattern)* ','?)?
PatternMap = (PatternPair (',' PatternPair)* ','?)?
PatternPair = ClosedPattern ':' Pattern | '**' ID
Yield = 'yield' ('from' Expr | StarExprs?)
StarExprs = StarExpr (',' StarExpr)* ','?
StarExpr = '*' BitOr | Named
Exprs = Expr (',' Expr)* ','?
Named = (ID ':=')? Expr
Expr = 'lambda' LParams ':' Expr | Or ('if' Or 'else' Expr | @noif)
LParams = (LPos (',' LStar)? ','? | LStar ','?)?
LPos = LBares (',' '/')? (',' LDefaults)? | LBares ',' '/' ',' LBares (',' LDefaults)? | (LBares ',')? LDefaults (',' '/' (',' LDefaults)?)?
LBares = LBare (',' LBare)*
LDefaults = LDefault (',' LDefault)*
LBare = ID
LDefault = ID '=' Expr
LStar = '*' ID (',' (LBare | LDefault))* (',' LStars)? | '*' (',' (LBare | LDefault))+ (',' LStars)? | LStars
LStars = '**' ID
Or = Not (('or' | 'and') Not)*
Not = 'not'* Cmp
Cmp = BitOr (CmpOp BitOr)*
CmpOp = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?
BitOr = Unary (BinOp Unary)*
BinOp = '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@'
Unary = ('+' | '-' | '~')* Power
Power = 'await'? Primary ('**' Unary | @nopower)
Primary = Atom Trail*
Trail = '.' ID | p:Args | s:Slices
Args = (Arg (',' Arg)* (',' Keywords)? ','? | Keywords ','?)? | Named Comp+
Arg = Named | '*' Expr
Keywords = Keyword (',' Keyword)* (',' Rest)* | Rest (',' Rest)*
Keyword = ID '=' Expr | '*' Expr
Rest = '**' Expr | ID '=' Expr
Slices = Slice (',' Slice)* ','?
Slice = Expr? ':' Expr? (':' Expr?)? | StarExpr
Atom = ID | NUM | STR+ | 'None' | 'True' | 'False' | '...' | p:Parens | s:ListItems | b:DictOrSet
Parens = (StarExprs | Yield | Named Comp+)?
ListItems = (StarExprs | Named Comp+)?
Comp = 'async'? 'for' StarTargets 'in' Or ('if' CompIf)*
CompIf = (ID ':=')? (Or | 'lambda' LParams ':' Expr)
DictOrSet = (Pair (',' Pair)* ','? | Expr ':' Expr Comp+ | StarExprs | Named Comp+)?
Pair = Expr ':' Expr | '**' BitOr
FString = (Yield | StarExprs)
"""

MEMO = {
    "go": {"Top", "Stmt", "Expr", "Type", "Field", "Elt", "Import", "ConstSpec", "Param", "HExpr"},
    "java": {"Member", "BlockStmt", "Stmt", "Expr", "Type", "Ternary", "Formal", "Import", "Init", "Act", "Postfix", "Unary", "ClassType"},
    "rust": {"Item", "Stmt", "Expr", "Type", "Pattern", "Arm", "Path", "FieldDef", "Blocky", "Cmp", "Postfix", "Unary"},
    "javascript": {"Stmt", "TStmt", "Assign", "Member", "Prop", "Import", "Export", "Left", "Cond", "Unary"},
    "python": {"Stmt", "Line", "Suite", "Expr", "StarExprs", "BitOr", "Primary", "StarTargets", "Arg", "Bare", "Default", "Small"},
}
MEMO["typescript"] = MEMO["javascript"] | {"Type", "TypeMember", "Union"}

#: Language: (grammar text, dialects that are tried together).
LANGUAGES = {
    "go": (GO, ["File"]),
    "java": (JAVA, ["File"]),
    "rust": (RUST, ["File"]),
    "javascript": (SCRIPT + PLAIN, ["Script", "Module"]),
    "typescript": (SCRIPT + TYPED, ["Script", "Module"]),
    "python": (PYTHON, ["File"]),
}


@lru_cache(maxsize=None)
def load(language: str) -> Grammar:
    text, starts = LANGUAGES[language]
    return Grammar(text, starts, MEMO[language])

"""Usual English words of documentation and source code: each stands in 20 or more files of a Python installation, its help topics and license texts."""

WORDS = frozenset(
    """
aaa aaaa aab abbreviation abc abcd abcdataframe abcde abcdef abcdefg abcdefghijklmnopqrstuvwxyz abcindex abcmeta abcseries abd abfnrtv abi ability able abort
aborted about above abs absence absent absolute abspath abstract abstractmethod abstractmethoderror abstractset acc accept acceptable accepted accepting accepts
access accessed accesses accessible accessing accessor accessors accidentally according accordingly account accumulate accumulated accumulation accumulator
accumulators accuracy accurate achieve achieved acos acosh acquire across act action actions activate activated activation active acts actual actually adapt
adapted adapter add addcleanup added addhandler adding addition additional additionally additions addoption addr address addresses addrs adds addserializedfile
addtest adjacent adjust adjusted adjustment advance advanced advantage advised aenter aexit affect affected affects affix after afterwards again against age
agent agg aggregate aggregated aggregating aggregation aggregations agree agreed agreement agreements ahead aiter aix aka alarm alert algebra algo algorithm
algorithms algos alias aliased aliases aliasing alice align aligned alignment aligns alist alive all allclose allfloat allinteger alloc allocate allocated
allocation allow allowed allowing allows almost alone along alongside alpha alphabet alphanumeric already also alt alter altered alternate alternative
alternatively alternatives although always amax ambiguity ambiguous america among amount amp analogous analyse analysis analyze anchor anchored and android
anext angeles angle animal ann annotate annotated annotation annotations anonymous another ansi answer any anymore anyone anything anyway anywhere apache apart
api apis app apparently appear appearance appears append appended appender appending appends apple applicable application applications applied applies apply
applying applymarker appname approach appropriate appropriately approx approximate approximately approximation apr april arange arbitrarily arbitrary arccos
arccosh arch architecture archive archives arcsin arcsinh arctan arctanh are area aren arg argcount argmax argmin argname argparse argparsing args argsort
argtypes argument argumentparser arguments argv arise arising arith arithmetic arm around arr array arraylike arraymanager arrays arraytype arrow arrowdtype
arrowextensionarray arrowinvalid arrs asanyarray asarray asc ascending ascii ascontiguousarray asdf asdict asf asfreq asia asin asinh ask asked asm asof aspects
assemble assert assertalmostequal assertcountequal assertequal assertfalse assertgreater assertgreaterequal assertin assertion assertionerror assertions
assertis assertisinstance assertisnone assertisnot assertisnotnone assertless assertlessequal assertlistequal assertnotequal assertnotin assertnotisinstance
assertraises assertraisesregex assertregex asserts asserttrue assertwarns assertwarnsregex assign assigned assigning assignment assignments assigns associated
assume assumed assumes assuming assumption assumptions ast astimezone astype async asynchronous asyncio atan atanh atexit atleast atol atom atomic attach
attached attempt attempted attempting attempts attention attn attr attrgetter attrib attribute attributeerror attributes attrs audio audit aug august auth
authenticate authentication author authorization authors auto automatic automatically autouse aux auxiliary available average avg avoid avoided avoiding avoids
await awaitable awaited aware away axes axis axiserror axisint bac back backed backend backends backfill background backing backport backslash backslashes
backslashreplace backspace backtick backup backward backwards bad badly bail banana band bar bare barrier barry bars base based basedistribution baseexception
baseline basemaskedarray basemodel basename baseoffset bases basestring basetestcase basic basically basics basis bat batch batched batches baz bdate bday
because become becomes been beep before begin beginning begins behave behaves behavior behaviors behaviour behind being believe belong belongs below benchmark
benefit berlin bert besides best beta better between beware beyond bfill bgcolor bias big bigger bigint bigmemtest bin binary binaryio binascii bind binding
bindings binomial binop bins bio bisect bit bitmap bits bitwise black blah blank blanks blob block blocked blocking blockingioerror blockmanager blocks
blocksize blow blue bob body bogus bold bom boo book bool boolean booleanarray booleandtype booleans booleantype bools boom bootstrap border borrowed both
bother bottom bound boundaries boundary bounded bounds box boxed boxes boxplot bpo brace braces bracket brackets branch branches break breaking breakpoint
breaks bring broadcast broadcasting broadcasts broken brokenpipeerror brown browse browser bucket buckets buf buffer buffered bufferedreader bufferedwriter
buffererror bufferhasidentifier buffering buffers bufsize bug buggy bugs build builder building buildmessageandenumdescriptors builds
buildtopdescriptorsandmessages built builtin builtins bunch bundle business busy but button bye bygroups bypass byref byte bytearray bytecode byteorder bytes
bytesio bytestring byteswap byteswarning cab cache cacheable cached caches caching calc calcsize calculate calculated calculates calculating calculation
calculations calendar call callable callables callback callbacks called calledprocesserror caller callers calling calls came can cancel cancellation cancelled
cancellederror candidate candidates cannot canonical canonicalize cant cap capabilities capacity capi capital capitalize caps caption capture captured captures
capturing care careful carefully carriage carry cartesian case cased casefold cases cast casted casting casts cat catalog catch catches catching categorical
categoricaldtype categoricalindex categoricals categories category cats caught cause caused causes causing caution cdata cdouble ceil ceiling cell cells center
centered central cert certain certificate certificates certs cet cflags cgi chain chained chaining chainmap chance change changed changes changing channel
channels char character characters charge chars charset chdir cheap check checked checker checkers checking checkpoint checks checksum chi chicago child
children chmod choice choices choicet choose choosing chosen chrome chunk chunked chunkedarray chunking chunks chunksize cipher circle circuit circular
circumstances claim claims clamp class classes classic classification classmethod classmethods classname classnotfound classvar clause clean cleaned cleaning
cleanly cleanup clear cleared clearfield clearing clearly clears cli click client clients clip clipboard clock clone clongdouble close closed closely closer
closes closest closing closure cluster clustering cmdline coalesce code codec codecs coded codepoint codes codetype coding coef coefficient coefficients coerce
coerced coerces coercing coercion col collapse collate collect collected collecting collection collections collector collects collision collisions colname colon
colons color colorize colors cols column columnorname columns com combination combinations combine combined combines combining come comes coming comma command
commands commas comment commented comments commercial commit common commonly communicate communication comp compact comparable compare compared compares
comparing comparison comparisons compat compatibility compatible compilation compile compiled compiler compiling complain complement complete completed
completely completes completion completions complex complexfloating complexity compliance compliant complicated component components compose composed composite
compound comprehension comprehensions comprehensive compress compressed compression compressor computation compute computed computer computes computing con
concat concatenate concatenated concatenating concatenation concept concepts concerns concrete concurrent cond condition conditional conditions conf config
configdict configs configuration configurations configure configured confirm conflict conflicting conflicts conform conforming conforms conftest confused
confusing confusion conj conjecture conjecturedata conjugate conjunction conn connect connected connecting connection connectionerror connectionreseterror
connections cons consecutive consequence consequential consider considered considering consist consistency consistent consistently consisting consists console
consoleoptions consolidate consolidated const constant constants constraint constraints construct constructed constructing construction constructor constructors
constructs consts consume consumed consumer consumers consumes consuming consumption cont contact contain contained container containers containing contains
content contents context contextlib contextmanager contexts contextvar contextvars contiguous continuation continue continued continues continuous contract
contrast contrib contributor contributors control controlled controlling controls conv convenience convenient convention conventions conversion conversions
convert converted converter converters convertible converting converts cookie cookiejar cookies coord coordinate coordinates coords copied copies copy copyfile
copyfrom copying copyreg copyright copysign core cores coreschema corner coro coroutine coroutines corporation corr correct correction correctly correctness
correlation correspond correspondence corresponding corresponds corrupt corrupted corrwith cos cosh cost costly could couldn count counted counter counters
counting country counts couple course cov covariance covariant cover coverage covered covers cow cpickleserializer cpu cpuexecutionprovider cpus cpython crash
crashes creat create created createdataframe creates creating creation creator credentials creso criteria critical cross csingle cte ctest ctime ctor ctype
ctypes cube cuda cudaexecutionprovider cummax cummin cumprod cumsum cumulative cur curdir curly curr current currently cursor curve custom customize customized
cut cutoff cyan cycle cycles cyclic cygwin cython daemon daily damages dangling dark darwin dash dat data database databases dataclass dataclasses dataframe
dataframegroupby dataframes datapath dataset datasets datasource datatype datatypes date dateoffset dates datetime datetimearray datetimeindex datetimelike
datetimes datetimetz datetimetzdtype dateutil day daylight dayofweek dayofyear days ddof deactivate dead deadline deadlock deal dealing dealloc debian debug
debugger debugging dec december decide decimal decimals decision decl declaration declarations declare declared decode decoded decoder decoders decodes decoding
decompress decompression decorate decorated decorator decorators decreasing decref dedent dedicated deduplicate deep deepcopy deeply def default defaultdict
defaulting defaults defect defects defensive defer deferred define defined defines defining definitely definition definitions defs deg degree degrees del
delattr delay delayed delegate delegation delete deleted deletes deleting deletion deliberately delim delimited delimiter delimiters delitem delta deltas demand
demo demonstrating denied denominator denote denotes dense density deny dep depend dependencies dependency dependent depending depends depr deprecate deprecated
deprecation deprecations deprecationwarning deps depth dequantizelinear deque der derivative derivatives derive derived desc descendant descending descr
describe described describes describing description descriptions descriptor descriptors deserialize deserialized deserializer design designed desirable desired
desktop despite dest destination destroy destroyed destructor detach detail detailed details detect detected detection detects determine determined determines
determining deterministic dev developer developers development deviation device devices devnull dgram diag diagnostic diagonal dialog dict dictionaries
dictionary dictlike dicts did didn die diff differ difference differences different differentiate differently differing differs difficult difflib diffs
diffusion digest digit digits dim dimension dimensional dimensionality dimensions dims dir direct direction directive directives directly directories directory
dirname dirs dirty dis disable disabled disables disabling disallow disallowed disallows discard discarded discarding disclaimer disclaims disconnect
discouraged discover discovered discovery discrete discussed discussion disk disp dispatch dispatcher display displayed displaying displays disposition dist
distance distinct distinction distinguish distinguishing distribute distributed distribution distributions distutils ditto div divide divided divisible division
divisor divmod django doc docs docstring docstrings doctest doctests doctestsuite doctype document documentation documented documents does doesn doesnt dog
doing dom domain domains don done dont dos dot dotall dots dotted double doubles doubletype down downcast downcasting download downloaded downloading downstream
drain draw drawing drawn draws drive driver drop droplevel dropna dropped dropping drops dry dta dti dtype dtypelike dtypeobj dtypes dual duck due dumb dummies
dummy dump dumps dunder dup duplex duplicate duplicated duplicates duplication dups duration durations during dword dynamic dynamically eacces each eager
eagerly earlier early eas easier easily east eastern easy ebadf echo edge edges edit editable edition editor edu effect effective effectively effects efficiency
efficient efficiently effort egg eggs eight einsum einval either elapsed elem element elements elementtree elementwise elems elif eliminate ellipsis else elseif
elsewhere elt email embed embedded embedding embeddings emit emits emitted emitting emph emphstrong empty emscripten emulate enable enabled enables enabling enc
encapsulates enclosed enclosing encodable encode encoded encoder encoders encodes encoding encodings encounter encountered encrypted end ended endian endianness
endif ending endobject endpoint endpoints ends endswith enforce enforced engine engines english enoent enough ensure ensures ensuring enter entercontext entered
entering entire entirely entities entity entries entry entrypoint enum enumerate enums env environ environment environments environmentvarguard eof eoferror eol
eos epoch eps epsilon equal equality equally equals equation equiv equivalence equivalent equivalents erase erf eric err errmsg errno error errorclass errors
errstate esc escape escapechar escaped escapes escaping especially essentially est establish established estimate estimated estimates estimation estimator etc
etree euro europe eval evaluate evaluated evaluates evaluating evaluation evaluator even evenly event eventloop events eventually ever every everyone everything
everywhere evil evt ewm exact exactly examine example examples exc exceed exceeded exceeds excel except excepthook exception exceptiongroup exceptions excess
exchange excinfo excl exclude excluded excludes excluding exclusion exclusive exe exec executable execute executed executes executing execution executor
executors exercise exhausted exhaustive exist existed existence existent existing exists exit exitcode exited exiting exits exitstack exp expand expanded
expanding expands expandtabs expanduser expansion expect expectation expected expecting expects expensive experimental expired explain explained explanation
explicit explicitly explode exponent exponential export exported exporting exports expose exposed exposes expr express expressed expression expressions exprs
ext extend extended extending extends extension extensionarray extensionarrays extensiondtype extensions extent extern external externally extra extract
extracted extracting extraction extracts extras extreme extremely eye fabs face facing fact factor factorial factories factorize factors factory fail failed
failfast failing fails failure failures fairly fake fakepath fall fallback falling falls false families family fancy far fashion fast faster fastest fastpath
fatal fault faulthandler favor fdopen feature features featurescol feb february fed fee feed fetch fetched fetching few fewer ffill fget field fieldinfo
fieldnames fields fifo fifth fig figure file filecopyrighttext fileexistserror fileio filename filenames fileno filenotfounderror fileobj filepath files
filesystem filesystems filetype fill filled filling fillna fills filter filtered filtering filters filterwarnings fin final finalization finalize finalized
finalizer finally find findall finder findfile finding finditer finds fine finfo finish finished finishes finite first firstlineno fish fit fitness fits fitted
fitting five fix fixed fixes fixing fixme fixture fixtures flag flags flaky flat flatbuffers flatmap flatten flattened flex flexibility flexible flip float
floating floatingarray floatingpointerror floats floor floordiv flow flush flushed flushes flushing fly fmod fname fnmatch fold folded folder folding follow
followed following follows font fontsize foo foobar footer for forall forbid forbidden force forced forces forcing foreach foreground foreign forever forget
fork forkserver form format formats formatted formatter formatters formatting formed former forms formula fortran forward forwarded forwardref forwards found
foundation four fourth frac fraction fractional fractions fragment fragments frame frames framework frameworks free freebsd freed freedom freeze freq freqs
freqstr frequencies frequency frequently fresh frexp fri friday friendly friends from frombuffer fromfile fromhex fromkeys fromlist fromstring fromtimestamp
front frozen frozenset frozensets fsdecode fsencode fspath fsspec fstat full fullmatch fullname fully fun func funcname funcs function functional functionality
functions functiontype functools further furthermore fuse fused fusion fut future futures futurewarning gain gamma gap gaps garbage gateway gather gaussian gave
gelu gemm gen gencode general generally generate generated generates generating generation generator generators generic genericalias generics geometric geometry
get getaddrinfo getattr getattribute getcwd getenv getfield getfilesystemencoding getfixturevalue getframe getgroup gethostname getini getitem getline getlogger
getmembers getnewargs getoption getorcreate getpath getpeername getpid getpwuid getrecursionlimit getrefcount getrootas gets getsize getsizeof getslice
getsockname getstate getter gettimeout getting gettotalrefcount gettrace gettz getuid geturl getvalue ghi gib gid gif gil git github give given gives giving
glibc glob global globally globals globs gmail gmtime gnu goal goes going gone good goodbye google got goto governed governing gpu grab gracefully grad gradient
grammar granted graph graphics graphs gray great greater greatest greedy greek green grey grid group groupby groupdict grouped grouper grouping groups grow
guarantee guaranteed guarantees guard guess guessed gui guide guido gzip gzipfile hack had half ham hand handle handled handler handlers handles handling
handshake hang happen happened happening happens happy hard hardcoded has hasattr hasfield hash hashable hashbang hashed hashes hashing hashlib hashtable hasn
hasnans have haven having head header headers heading heads health healthcheck heap heavily height held hello help helper helpers helpful helps hence here
hereby heredoc heterogeneous heuristic hex hexadecimal hexdigest hidden hide hierarchical hierarchy high higher highest highlight highlighted highlighter
highlighting highly hint hints hist histogram historical historically history hit hits hkey hold holder holders holding holds hole home homogeneous honored hook
hookimpl hooks hope hopefully horizontal horse host hostname hosts hot hour hours how however href hstack httpconnection httperror httplib httpresponse
httpserver huge huggingface human hyphen hyphens hypot hypothesis hypothesisworks iadd iana iand iat ibm idea ideal ideally idempotent ident identical
identically identified identifier identifiers identifies identify identifying identity idle idna ids idx idxmax idxmin ieee ietf ifdef iff ignore ignorecase
ignored ignores ignoring iinfo illegal iloc imag image images imaginary imap immediate immediately immutable imp impact impl implement implementation
implementations implemented implementing implements implicit implicitly implied implies imply import importable important imported importer importerror
importing importlib importorskip imports importwarning impossible improve improved imul inat inc include included includes including inclusion inclusive
incoming incompatible incomplete inconsistent incorrect incorrectly increase increased increases increasing increment incremental ind indeed indent indentation
indented indents independent independently index indexed indexer indexerror indexers indexes indexing indexlabel indexopsmixin indexslice indicate indicated
indicates indicating indicator indices indirect indirectly individual individually inds inequality inet inexact inf infer inference inferencesession inferred
inferring infers infile infinite infinities infinity infix info information informative infos infs ing inherit inheritable inheritance inherited inheriting
inherits ini init initial initialization initialize initialized initializer initializers initializes initializing initially inject injected injection inline
inner innermost ino inout inp inplace input inputcol inputs ins insensitive insert inserted inserting insertion insertions inserts inside inspect inspection
inspired inst install installation installationerror installed installing installrequirement installs instance instancecheck instances instantiate instantiated
instantiating instantiation instead instr instruction instructions insufficient int intact intc integer integerarray integers integertype integral integrate
integration integrity intel intended intent intentionally intenum inter interact interaction interactive intercept interchange interest interested interesting
interface interfaces interfere interleave intermediate intern internal internally internals internet interp interpol interpolate interpolated interpolation
interpret interpretation interpreted interpreter interpreters interrupt interrupted intersect intersection interval intervalarray intervaldtype intervalindex
intervals into intp intrinsic introduce introduced introduces introspection ints inv invalid invalidargument invalidate invalidindexerror invariant inverse
inversion invert inverted invisible invocation invocations invoke invoked invokes invoking involve involved involving ioerror ior ipaddress ipc ipython
irrelevant isabs isadirectoryerror isalnum isalpha isascii isatty isclass iscoroutinefunction isdecimal isdigit isdir isdisjoint isempty isfile isfinite
isfunction isidentifier isin isinf isinstance iskeyword islice islink islower isn isna isnan isnat isnotnull isnull isnumeric iso isoformat isolated isolation
isscalar isspace issubclass issubdtype issubset issue issuecomment issued issues istitle isub isupper italic item itemgetter items itemsize iter iterable
iterables iterate iterated iterates iterating iteration iterations iterator iterators iterdir iteritems iters itertools its itself ixor jan january jar java
javagateway javaobject javascript jim jira jit job jobs joe john join joined joining joinpath joins jpeg json jsondecodeerror jul jump jumps jun june junk
jupyter just justify jython kde keep keepdims keepends keeping keeps kept kernel kernels key keyboard keyboardinterrupt keyed keyerror keys keyword keywords kib
kill kind kinds klass know knowledge known knows kurt kurtosis kwarg kwargs kwdefaults lab label labelcol labeled labeledpoint labels lack lacks lag lambda
lambdas lang language languages large larger largest last late latency later latest latex latin latter launch law layer layernorm layernormalization layers
layout lazily lazy ldexp lead leading leads leaf leak leaked leaks leap learn learning least leave leaves leaving left leftmost legacy legal legend len length
lengths lenient less let lets letter letters lev level levelname levels lex lexer lexers lexical lexicographically lexsort lexsorted liability liable lib libc
libindex libraries library libs libsvm license licensed licenses lies life lifetime light like likely likes likewise limit limitation limitations limited limits
linalg line linear linecache lineno linenos lines linesep link linked linker linking links linspace linux list listdir listed listen listener listening listing
listlike lists lit literal literals little live ljust load loaded loader loading loads loc local locale locales localhost localize localized locally localns
locals localtime locate located location locations locator lock locked locks locs log logged logger logging logic logical logically login logistic logits logs
london lone long longdouble longer longest longlong longtype look lookahead looked looking looks lookup lookuperror lookups loop loopback loops loose los lose
loses losing loss losslessly lost lot lots low lower lowercase lowest lru lshift lstat lstrip lzma mac machine machinery machines macos macosx macro macros made
magenta magic magicmock magnitude mail main mainloop mainly maintain maintained maintains major make makedirs makefile maker makes maketrans making malformed
malloc man manage managed management manager managers manages managing mandatory mangle mangled manifest manipulate manipulation manner manual manually many map
mapped mapper mapping mappingproxytype mappings maps mar march margin mark marked marker markers marking marks markup marshal mask masked maskedarray masking
masks master mat match matched matcher matches matching material math mathematical matmul matplotlib matrices matrix matter matters max maxdiff maximal maximize
maximum maxiter maxlen maxsize maxsplit maxunicode may maybe mean meaning meaningful means meant measure measured measurement measures mechanism media median
medium meet mem member members membership memo memoize memory memoryerror memoryview memuse mentioned menu merchantability merely merge merged merges mergesort
merging meson mess message messageparameters messages met meta metaclass metaclasses metadata metavar meth method methodname methods methodtype metric metrics
mib michael micro micros microsecond microseconds microsoft mid middle midnight midpoint midx might migration millisecond milliseconds mime mimetypes mimic
mimics min minimal minimize minimum minmax minor minus minute minutes mirror mirrors misc miscellaneous mismatch mismatched miss missed missing mistake mit mix
mixed mixin mixing mixins mkdir mkdtemp mkstemp mktemp mktime mllib mmap mobile mock mocked mocks mod mode model modeling modelproto models modern modes modf
modification modifications modified modifier modifiers modifies modify modifying modname module modulename modulenotfounderror modules modulespec moduletype
modulo moment mon monday monitor monkey monkeypatch monotonic monotonically month monthend monthly months more most mostly mount mouse move moveaxis moved moves
moving mozilla mro mtime much mul mult multi multiarray multidimensional multiheadattention multiindex multiline multipart multiple multiples multiplication
multiplied multiplier multiply multiprocessing musl must mutable mutablemapping mutablesequence mutate mutated mutating mutation mutually myclass myint mypy
naive name named namedtemporaryfile namedtuple namedtuples nameerror namelist names namespace namespaces naming nan nanmax nanmin nano nanops nanos nanosecond
nanoseconds nans nansum nargs narrow nas nasty nat native natively nattype natural nature nbar nbytes ncols ndarray ndarrays ndef ndframe ndiff ndim ndmin
ndtype near nearest necessarily necessary need needed needing needs neg negate negative negligence neither nep nest nested nesting net netloc network never new
newaxis newbyteorder newer newline newlines newly newtype next nextafter ngroups nice nicer nil nlevels nobody node nodefault nodeid nodeproto nodes nogil noise
noitalic non nonascii none nonempty nonetype nonexistent nonexisting nonlocal nonnegative nonsense nonzero noop nop nopython noqa nor noreturn norm normal
normalization normalize normalized normalizer normalizes normalizing normally normcase normpath not notadirectoryerror notation note notebook notes nothing
notice notified notify notimplemented notimplementederror notna notnull nov novalue now nowait npy nrows nul null nullable nullcontext nulls num numba number
numbered numbers numelems numerator numeric numerical numerictypes numexpr numpartitions numpy numpyextensionarray nums nunique obj object objects objs obs
observation observations observe observed obsolete obtain obtained obtaining obvious occur occurred occurrence occurrences occurring occurs oct octal octet odd
off offer offers official offset offsets often ohlc okay old older omit omitted omitting once one ones online only onnx onnxmodel onnxruntime onto oob opaque
opcode opcodes open opened opener opening opens openssl operand operands operate operated operates operating operation operations operator operators opname
opposed opposite ops opset opt optimal optimization optimizations optimize optimized optimizer option optional optionally optionflags options optparse opts
orange orc ord order orderby ordered ordereddict ordering orders ordinal ordinary org orient orientation oriented orig origin original originally ort oserror
osx other others otherwise our ourselves out outcome outcomes outer outermost outfile outofboundsdatetime output outputcol outputs outside over overall overflow
overflowerror overflows overhead overlap overlapping overlaps overlay overload overloaded overloads overridden override overrides overriding overview overwrite
overwrites overwriting overwritten own owned owner ownership pacific pack package packages packaging packed packer packing pad padded padding page pages pair
pairs pairwise pandas panel paper paragraph parallel parallelize param parameter parameterize parameterized parameters parametrization parametrize parametrized
params paramspec pardir paren parens parent parentheses parenthesis parents parity parquet parrot parse parsed parser parsererror parsers parses parsing part
partial partially particular particularly parties partition partitionby partitioned partitioning partitions parts party pascal pass passed passes passing passwd
password past paste pat patch patched patches patching path pathlib pathlike pathname paths pathsep pattern patterns pause payload peak pearson peek peer pem
pending people pep peps per percent percentage percentile percentiles perf perfect perform performance performancewarning performant performed performing
performs perhaps period periodarray perioddtype periodic periodindex periods perl perm permanently permission permissionerror permissions permit permitted
permutation permutations permute persist persistent person peterson pformat pgo phase phi phrase physical pick picked picklable pickle pickled pickles pickling
picklingerror pid piece pieces pin ping pink pinned pip pipe pipeline pipelines pipes pivot place placed placeholder placement places plain plan plane platform
platforms play please plot plots plotting plugin pluginmanager plugins plural plus point pointed pointer pointers pointing points pointwise poisson policy poll
poly polynomial pool poolmanager poor poorly pop popen popitem popleft popped populate populated population port portable portion portions pos position
positional positions positive positives posix posixpath possibilities possibility possible possibly post potential potentially pow power powers pprint practice
pragma pre preamble prec preceded precedence preceding precise precisely precision pred predefined predicate predicates predict predicted prediction
predictioncol predictions prefer preference preferred prefix prefixed prefixes preload prep preparation prepare prepared prepend prepended
prependuoffsettrelativeslot preproc preprocess prereleases presence present presented preservation preserve preserved preserves preserving press pretend
pretrained pretty prev prevent prevents previous previously price primarily primary prime primitive primitives principle print printable printed printer printf
printing printoptions prints prior priority private prob probabilities probability probably problem problematic problems proc procedure proceed process
processed processes processing processlookuperror processor prod produce produced producer produces producing product production products profile profiler
profiling profits prog program programming programs progress prohibited project projection projects promote promotion prompt prompts prop propagate propagated
propagates propagation proper properly properties property proportion props protect protected protection proto protobuf protoc protocol protocols prototype
prove provide provided provider providers provides providing proxies proxy prune pseudo psutil pthread public publish published pull punctuation pure purely
purple purpose purposes push put putmask puts putting pyarrow pyc pycache pydantic pydanticusererror pydata pydatetime pydict pydoc pygments pylint pylist
pyobject pypa pypi pyplot pyproject pypy pyrepl pyright pyspark pysparkruntimeerror pysparksession pysparktypeerror pysparkvalueerror pytables pytest pytestmark
python pythonapi pythonpath pythontest pytimedelta pytorch pytz pyx qname quadratic qualified quality qualname quant quantile quantiles quantity quantization
quantize quantized quantizer quantoperatorbase quarter queries query question questions queue queues quick quickly quicksort quiet quit quite quot quote
quotechar quoted quotes quotient quoting quux qux race radd radians ragged raise raised raises raising ran rand randint randn random randomly randomsplit
randomstate randrange range rangeindex ranges rank ranks rare rarely rate rather ratio rational ravel raw rdiv rdivmod rdonly reach reachable reached reaches
read readable readbuffer reader readers reading readinto readline readlines readlink readonly reads readthedocs ready real really realpath reap reason
reasonable reasonably reasons rebuild rec recarray receive received receives receiving recent recently recipes reciprocal recognised recognize recognized
recommend recommended recompute reconstruct reconstructed record recordbatch recorded recording records recover recreate rect rectangle recurse recursion
recursionerror recursive recursively recv red redirect redirected redirection redirects redistribute reduce reduced reduces reducing reduction reductions
redundant reentrant ref refactor refactoring refcount refer reference referenced references referencing referred referring refers refleaks reflect reflected
reflection refresh refs reg regard regarding regardless regex regexes regexlexer regexp region register registered registering registers registration registry
regparam regression regrtest regular reindex reindexing reject rejected rejects rel related relation relations relationship relative relatively release released
releases relevant reliable reliably relies reload relpath rely relying rem remain remainder remaining remains remember remote removal remove removed
removeprefix removes removesuffix removing rename renamed renaming render renderable renderabletype rendered rendering renderresult renders reorder reordered
rep repeat repeated repeatedly repeating repeats repetition repetitions repl replace replaced replacement replacements replaces replacing replay replicate reply
repo report reported reporting reports repository repr represent representable representation representations represented representing represents reproduce
reprs req reqs request requested requesting requests require required requirement requirements requires requiring reraise rerun res resample reserved reset
resets resetting reshape reshaped reshaping residual resize reso resolution resolutions resolve resolved resolver resolves resolving resource resources
resourcewarning resp respect respected respective respectively respects response responses responsibility responsible rest restart restore restored restores
restoring restrict restricted restriction restrictions restype result resultant resulting results resume ret retain retained retains retries retrieval retrieve
retrieved retrieves retry return returncode returned returning returns returntype retval reusable reuse reused rev reverse reversed revert revised revision
rewind rewrite rewritten rfind rfloordiv rich rid right rightmost rights rindex ring rint risk rjust rlock rmdir rmod rmtree rmul robust role roll rollback
rolling room root roots ror rot rotate rotation roughly round rounded rounding rounds roundtrip routine routines row rows rpartition rpow rshift rsplit rstrip
rsub rtol rtruediv rtype rule rules run runner running runs runtest runtime runtimeerror runtimewarning rxor safe safely safety said same samefile samemodel
sample sampled samples sampling san sane sanitize sanitizer sanity sans sas sat satisfied satisfies satisfy satisfying saturday save saved saves saving saw say
says scala scalar scalars scale scaled scales scaling scan scanned scanner scanning scatter scenario scenarios schedule scheduled schema schemas scheme schemes
scientific scipy scol scope scoped scopes score scores screen script scripts scroll sdist search searched searches searching searchsorted searchstrategy sec
second secondary seconds secret secs section sections secure security see seed seeing seek seekable seem seems seen sees segfault segfaults segment segmentation
segments sel select selected selecting selection selector selectors selects self sem semantics semaphore semi semicolon send sendall sendfile sending sends
sendto sense sensible sensitive sent sentence sentinel sep separate separated separately separating separator separators seq sequence sequences sequential ser
serial serializable serialization serialize serialized serializer serializers serializetostring serializing series seriesgroupby serve server servers serves
service services serving sess session sessionoptions sessions set setattr setblocking setdefault setenv setflags setitem setlevel setlocale sets setsockopt
setstate setter settimeout setting settings settrace setup setupclass setupmodule setuptools seven several shadow shall shallow shape shapes share shared shares
sharing shebang sheet shell shift shifted shifting shim shlex short shortcut shorten shorter shortest shorthand should shouldn show showing shown shows shrink
shrinking shuffle shut shutdown shutil sibling side sides sig sigint sigma sign signal signals signature signatures signed signedinteger significant
significantly signs signum sigterm silence silent silently similar similarly simple simplefilter simplenamespace simpler simplest simplicity simplified simplify
simply simulate simultaneously sin since single singleblockmanager singleton singletons singular sinh sink site situation situations six size sized sizeof sizes
skew skip skipif skiplayernormalization skipna skipped skipping skiprows skips skiptest skipunless slash slashes sleep sleeping slice sliced slices slicing
slightly slot slots slow slower slowest small smaller smallest smart smoke smooth snake snap snappy snapshot snippet sock socket socketpair sockets soft softmax
software sol solaris sole solely solid solution solve solved some somehow someone something sometimes somewhat somewhere soon sort sorted sorter sorting sorts
sound source sourcecode sourcefileloader sources space spaced spaces spacing spam span spans spark sparkcontext sparksession sparse sparsearray sparsedtype
spawn spawning spec special specialization specialized specially specific specifically specification specifications specified specifier specifiers specifies
specify specifying specs speed speedup sphinx split splitdrive splitext splitlines splits splitting spurious sqlite square squared squares squeeze ssize
sslcontext sslerror stability stable stack stacked stacking stacklevel stackoverflow stacktrace stage stages stale stamp standalone standard standardize
standards star start started starting startobject starts startswith startup startvector stash stat stata state stated stateful statement statements states
static staticmethod statistical statistics stats status statuses stay stays stddev stderr stdin stdio stdlib stdout stem step steps stick sticky still stop
stopasynciteration stopiteration stopped stopping stops storage storagelevel storageoptions store stored stores storing straight straightforward strange
strategies strategy stray stream streaming streamreader streams streamwriter strerror strftime strict stricter strictly stride strided strides string
stringarray stringdtype stringify stringio strings stringtype strip stripped stripping strips strlen strong strongly strptime struct structfield structs
structtype structural structure structured structures stub stuff style styler styles stylesheet sub subarray subclass subclasscheck subclassed subclasses
subclassing subdir subdirectories subdirectory subdirs subgraph subheading subinterpreters subject submit submodule submodules subnormal subok subplot subplots
subprocess subroutine subscript subsequent subsequently subset subsets substitute substituted substitution substr substring subtest subtle subtract subtracting
subtraction subtype subtypes succeed succeeded succeeds success successful successfully such sufficient sufficiently suffix suffixes suggest suggested suitable
suite suites sum summarize summary summed sums sun sunday sup super superclass superset supertype supplied supply supplying support supported supporting
supports suppose supposed suppress suppressed sure surprising surrogate surrogateescape surrogatepass surrogates surrounded surrounding suspend swap swapaxes
swapcase swapped swapping switch switches sym symbol symbolic symbols symlink symlinks symmetric symmetry sync synchronize syntactically syntax syntaxerror sys
syscall sysconfig system systemerror systemexit systems tab table tables tabs tabsize tabular tag tagged tags tail take taken takes taking tan tanh tar tarfile
target targets task tasks tau tclerror tda tdi team teardown teardownclass teardownmodule technically tell tells temp tempdir tempfile template templates
temporal temporarily temporary temporarydirectory temporaryfile ten tensor tensorproto tensorrt tensors term terminal terminate terminated terminates
terminating termination terminator terms test testbase testcapi testcase testcases testdata tested tester testfile testfn testfunc testing testinternalcapi
testlimitedcapi testmod testname testresult tests testsuite tex text textfile textio textiowrapper texts textual textwrap than thanks that the their them theme
themselves then theory there therefore thereof these they thin thing things think third this those though thought thousands thread threaded threading
threadpoolexecutor threads threadsafe three threshold thresholds through throughout throw throwing thrown throws thu thursday thus tick ticket ticks tied ties
tile tim time timed timedelta timedeltaarray timedeltaindex timedeltas timeout timeouterror timeouts timer times timeseries timestamp timestamps timestamptype
timezone timezones timing tiny title titles tkinter tmpdir toarray tobytes today todo together token tokenize tokenizer tokens tokensource tokyo tol told
tolerance tolist toml too took tool tools top toplevel torch tortious tostring total touch towards trace traceback tracebackhide tracebacks tracebacktype
tracemalloc tracer tracing track tracked tracker tracking tracks traditional trailing train trained training trans transaction transfer transform transformation
transformations transformed transformer transformers transforming transforms transient transition transitions translate translated translates translation
transparent transport transpose transposed trap traverse treat treated treating treatment treats tree trees triangle triangular trick tricks tricky tried tries
trigger triggered triggering triggers trim trimmed trip triple triples trivial trouble true truediv trunc truncate truncated truncates truncating truncation
trust trusted truth truthy try tryfirst trying tseries tslibs tty ttype tue tuesday tuning tup tuple tuples turn turned turns turtle tutorial twice two typ type
typealias typecode typecodes typed typeddict typedef typeerror typeguard typename typeof types typevar typevars typical typically typing tzaware tzdata tzinfo
tzlocal tzname ubuntu ubyte udf udp udt ufeff ufffd ufunc ufuncs ugly uid uint ulong ulonglong ultimately umask umath unable unaffected unaligned unambiguous
uname unary unavailable unbiased unbound unbounded unbox unbuffered unc uncache unchanged unclear unclosed uncompressed unconditionally undecodable undef
undefined under underflow underline underlying underscore underscores understand understood undo undocumented unencoded unequal unexpected unexpectedly
unfortunately unhandled unhashable uni unicode unicodedata unicodedecodeerror unicodeencodeerror unicodeerror unified uniform uniformly uninitialized uninstall
union unions uniontype unique uniquely uniques unit units unittest universal unix unknown unless unlike unlikely unlimited unlink unload unlock unmatched
unmodified unnamed unnecessarily unnecessary unordered unpack unpacked unpacking unparsed unpickle unpickled unpickling unprocessed unquote unquoted unraisable
unreachable unrecognized unregister unrelated unreliable unsafe unset unsigned unsorted unspecified unsqueeze unstable unstack unsupported unsupportedoperation
unterminated until untyped unused unusual unwrap unwrapped uoffset uoffsettflags upcast upcasting update updated updates updating upgrade upon upper uppercase
upstream urandom uri url urlencode urlerror urljoin urllib urlopen urlparse urls urlsplit usable usage use usecols used usefixtures useful useless user userdict
userid userlist username users userwarning uses ushort using usr usual usually utc utcoffset utf util utilities utility utils utime uuid val valid validate
validated validateprotobufruntimeversion validates validating validation validationerror validator validators validity vals value valued valueerror values van
var vararg varargs variable variables variance variant variants variation variations varies variety various varname varnames vars vary varying vec vector
vectorized vectorlen vectors vendor vendored venv ver verbatim verbose verbosity verification verified verifies verify verifying versa version versionadded
versionchanged versions versus vertical vertically very via vice view views vim violation virtual virtualenv visibility visible visit visited visitor visual
vocab void volatile volume vstack vxworks wait waiter waiting waitpid waits wake wakeup walk walking wall want wanted wants warm warmup warn warning warnings
warns warranties warranty warsaw was wasi wasm wasn watch way ways wchar weak weakref weakvaluedictionary web wed week weekday weeks weight weighted weights
weird welcome well went were what whatever whatsoever wheel wheels when whence whenever where whereas whether which while white whitespace whitespaces who whole
whose why wide wider widget width widths wiki wikipedia wild wildcard will win winapi windll window windows winerror winreg wins wire wise wish with withcolumn
within without won word words work workaround worked worker workers working works world worry worse worst worth would wouldn wrap wrapped wrapper wrappers
wrapping wraps writable write writeable writelines writer writers writes writing written wrong wronly wrote xaa xab xac xea xed xef xfail xfe xor xref xyz yaml
year yearend years yellow yes yet yield yielded yielding yields york you your yourself yyyy zero zerodim zerodivisionerror zeroes zeros zfill zip zipfile zlib
zone zoneinfo zones zstandard
""".split()
)

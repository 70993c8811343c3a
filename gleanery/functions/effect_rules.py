"""Which calls allocate, and which effects the calls of a standard library have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import identifiers, mentions_type, type_head

#: Effects by code.
EFFECTS = ["allocate", "block", "environment-read", "environment-write", "file-read", "file-write", "network", "process", "random", "time", "unsafe"]
#: Associated functions and methods that allocate.
ALLOCATING_ASSOCIATED = [
    "Arc::new", "Box::new", "CString::new", "HashMap::with_capacity", "HashSet::with_capacity", "OsString::from", "PathBuf::from",
    "Rc::new", "String::from", "String::with_capacity", "Vec::from", "Vec::with_capacity", "VecDeque::with_capacity",
]
ALLOCATING_METHODS = ["collect", "to_string", "to_vec"]
ALLOCATING_FUNCTIONS = ["std::fmt::format", "alloc::fmt::format"]
CLONE_ALLOCATES = ["BTreeMap", "BTreeSet", "Box", "CString", "HashMap", "HashSet", "OsString", "PathBuf", "String", "Vec", "VecDeque"]
TO_OWNED_ALLOCATES = ["CStr", "OsStr", "Path", "str"]
COLLECT_ALLOCATES = ["BTreeMap", "BTreeSet", "Box", "HashMap", "HashSet", "String", "Vec", "VecDeque"]
#: Operations of the file-system layer.
FILE_READS = ["canonicalize", "copy", "exists", "metadata", "read", "read_dir", "read_link", "readlink", "symlink_metadata", "try_exists"]
FILE_WRITES = ["copy", "create_dir", "hard_link", "remove_dir", "remove_dir_all", "remove_file", "rename", "set_permissions", "set_times", "soft_link", "symlink", "write"]
#: Effects by the end of a callee's path.
PATH_EFFECTS = {
    "env_imp::getenv": ["environment-read"],
    "env_imp::setenv": ["environment-write"],
    "env_imp::unsetenv": ["environment-write"],
    "time::Instant::now": ["time"],
    "time::SystemTime::now": ["time"],
    "imp::sleep": ["block", "time"],
    "imp::sleep_until": ["block", "time"],
    "net_imp::TcpStream::connect": ["block", "network"],
    "net_imp::TcpStream::connect_timeout": ["block", "network"],
    "imp::output": ["block", "process"],
}
#: Effects of operations called in std::process.
PROCESS_EFFECTS = {"spawn": ["process"], "kill": ["process"], "try_wait": ["process"], "wait": ["block", "process"]}


def effect_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(EFFECTS)), "code int, effect string")


def allocating_call(plain: Column) -> Column:
    """The allocating operation that a callee without generics names, or null."""
    names = identifiers(plain)
    last = F.try_element_at(names, F.lit(-1))
    pair = F.concat_ws("::", F.try_element_at(names, F.lit(-2)), last)
    return F.when(last.isin(ALLOCATING_METHODS), last).when((F.size(names) > 1) & pair.isin(ALLOCATING_ASSOCIATED), pair)


def allocating_macro(name: Column, has_arguments: Column) -> Column:
    return F.when(name == "format", F.lit("format!")).when((name == "vec") & has_arguments, F.lit("vec!"))


def allocating_destination(destination: Column, no_turbofish: Column, no_generics: Column, self_type: Column) -> Column:
    """As allocating_call, for a resolved destination: what clone, to_owned and
    collect give decides."""
    operation = F.try_element_at(identifiers(no_turbofish), F.lit(-1))
    target = F.element_at(F.split(destination, "::<"), -1)
    collected = F.try_element_at(F.array_compact(F.array(*[F.when(mentions_type(target, h), F.lit(h)) for h in COLLECT_ALLOCATES])), F.lit(1))
    head = type_head(self_type)
    named = F.concat(head, F.lit("::"), operation)
    return (
        F.when(no_turbofish.isin(ALLOCATING_FUNCTIONS), no_turbofish)
        .when(operation == "collect", F.when(destination.contains("::<"), F.concat(F.lit("collect::<"), collected, F.lit(">"))))
        .when(self_type.isNotNull() & (operation == "clone"), F.when(head.isin(CLONE_ALLOCATES), named))
        .when(self_type.isNotNull() & (operation == "to_owned"), F.when(head.isin(TO_OWNED_ALLOCATES), named))
        .otherwise(allocating_call(no_generics))
    )


def origin_effects(module: Column, callee: Column) -> Column:
    """Sorted effects of a call inside the standard library."""
    names = identifiers(callee)
    path, operation = F.concat_ws("::", names), F.try_element_at(names, F.lit(-1))
    found = [F.when(path.endswith(end), F.array(*map(F.lit, e))) for end, e in PATH_EFFECTS.items()]
    found += [F.when((module == "std::process") & (operation == o), F.array(*map(F.lit, e))) for o, e in PROCESS_EFFECTS.items()]
    in_fs = path.startswith("fs_imp::")
    found.append(F.when(in_fs & operation.isin(FILE_READS), F.array(F.lit("file-read"))))
    found.append(F.when(in_fs & operation.isin(FILE_WRITES), F.array(F.lit("file-write"))))
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*found)))))

"""Small relations that stand in for observations the driver's tables do not hold,
as SQL that Spark and DuckDB read alike."""

FIELDS = "SELECT * FROM (VALUES (1, 'extern struct', 'next', '*Node'), (2, 'extern struct', 'data', '*u8'), (3, 'struct', 'global', '*jsc.JSGlobalObject'), (4, 'struct', 'cb', '?*const fn (*anyopaque) void'), (5, 'struct', '#prev', '?*Node'), (6, 'struct', '_Parent', '*Tree'), (7, 'struct', 'shape', '*Transform'), (8, 'struct', 'count', 'u32'), (9, 'struct', 'next_tick_queue', '*Queue'), (10, 'struct', 'owner', '*Thing')) AS t(field_id, container_kind, name, zig_type)"
CALLABLES = "SELECT * FROM (VALUES (0, 'app::adapter', 'adapter', 'app', NULL), (1, 'app::service', 'service', 'app', NULL), (2, 'app::handler', 'handler', 'app', NULL), (3, 'app::handler::helper', 'helper', 'app', 'app::handler'), (4, 'util::Tree::walk', 'walk', 'util', NULL), (5, 'util::Graph::walk', 'walk', 'util', NULL), (6, 'util::helper', 'helper', 'util', NULL)) AS t(callable_id, path, name, module, parent)"
CALLS = "SELECT * FROM (VALUES (0, 0, 'std::fs::read', 's0'), (1, 1, 'adapter', 's1'), (2, 2, 'service', 's2'), (3, 2, 'helper', 's3'), (4, 3, 'Tree::walk', 's4'), (5, 4, 'walk', 's5'), (6, 4, 'Vec::with_capacity', 's6'), (7, 5, 'values.iter', 's7'), (8, 5, 'other::thing', 's8'), (9, 6, 'mystery', 's9'), (10, 6, 'Some', 's10'), (11, 6, 'std::env::var::<str>', 's11')) AS t(call_id, caller_id, callee, span)"
CATALOG = "SELECT * FROM (VALUES ('rust', '1', 'std::fs::read', array('file-read')), ('rust', '2', 'std::fs::read', array('block', 'file-read')), ('rust', '1', 'std::env::var', array('environment-read')), ('zig', '1', 'adapter', array('time'))) AS t(language, version, path, effects)"

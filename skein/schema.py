"""Tables of the code graph, and the words their columns use."""

NODE_SCHEMA = (
    "id string, type string, name string, content string, properties map<string,string>, file_path string, "
    "start_line int, end_line int, content_hash string, summary string, needs_analysis boolean, "
    "embedding array<float>, embedding_dim int, embedding_model string"
)
EDGE_SCHEMA = "source string, target string, relationship string, provenance int, properties map<string,string>"
DIAGNOSTIC_SCHEMA = "source string, code string, severity int, message string, node_id string, file_path string"

#: Trust in an edge: lower is better.
EXTRACTED, INFERRED, AMBIGUOUS = 0, 1, 2
TIER_NAMES = ("extracted", "inferred", "ambiguous")

# Relationship and type names that graphs on disk use.
STRUCTURAL = ("CONTAINS", "BELONGS_TO_MODULE")
#: Never made less certain by a parser's default.
STAMP_EXEMPT = ("CONTAINS", "DEFINED_IN")
DEFINITION_TYPES = ("Class", "Interface", "Record", "Struct", "Enum")
DECLARATION_TYPES = (*DEFINITION_TYPES, "Method", "Property", "Constructor")
#: What kinds of nodes there are: type, group, and whether one stands for a whole file.
NODE_TYPES = (
    ("File", "Files", True), ("MarkdownSection", "Documents", False), ("Class", "Code", False), ("Interface", "Code", False), ("Record", "Code", False), ("Struct", "Code", False),
    ("Enum", "Code", False), ("Method", "Code", False), ("Constructor", "Code", False), ("Property", "Code", False), ("JSComponent", "Code", True), ("GraphQLQuery", "Code", True),
    ("GraphQLFragment", "Code", True), ("GraphQLMutation", "Code", True), ("SitecoreItem", "CMS", True), ("SitecoreConfig", "CMS", True), ("ClrType", "Code", False),
    ("XmCloudComponent", "CMS", True), ("XmCloudRouteData", "CMS", True), ("OptiPageType", "CMS", False), ("OptiBlockType", "CMS", False), ("OptiProperty", "CMS", False),
    ("KenticoModule", "CMS", False), ("KenticoPageType", "CMS", False), ("KenticoFormComponent", "CMS", False), ("HelixModule", "Architecture", False), ("Concept", "Concepts", False),
    ("Decision", "Memory", False), ("Milestone", "Memory", False), ("Task", "Memory", False), ("Question", "Memory", False),
)
MEMORY_TYPES = ("Decision", "Milestone", "Task", "Question")
CLOSED_STATUS = ("done", "closed", "resolved", "completed", "cancelled")
HEURISTIC_RELATIONS = ("RELATES_TO", "IMPORTS", "OVERRIDES_BLOCK", "BINDS_TO")
IMPACT_RELATIONS = ("REFERENCES_TYPE", "IMPLEMENTS", "EXTENDS", "CALLS")
DEPENDENCY_RELATIONS = ("REFERENCES_TYPE", "IMPLEMENTS", "EXTENDS")

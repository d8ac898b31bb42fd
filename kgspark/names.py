"""Names of new nodes."""

#: How the graphs to be scored mark nodes that aren't in the knowledge graph, on the system's and on the gold side.
NEW_PREFIX = "http://createdbyedc.org/"
GOLD_PREFIX = "_:"

NEW_ENTITY = f"{NEW_PREFIX}entities/"
NEW_RELATION = f"{NEW_PREFIX}relations/"

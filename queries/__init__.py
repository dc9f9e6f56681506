"""The registered queries, each next to the SQL an independent engine checks it with."""

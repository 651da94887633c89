"""sparkloom: a read-only federated SQL engine on Spark."""

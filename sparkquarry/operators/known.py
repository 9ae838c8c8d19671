"""What names of packages, files, images and variables tell: small tables that joins broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The extensions in which a tool's config may be written as code.
CODE = "{js,cjs,mjs,ts,cts,mts}"

#: Framework id, its name, category and ecosystem; the order is that of display within a category.
FRAMEWORKS = [
    ("nuxt", "Nuxt", "fullstack", "node"),
    ("next", "Next.js", "fullstack", "node"),
    ("remix", "Remix", "fullstack", "node"),
    ("react-router", "React Router", "fullstack", "node"),
    ("sveltekit", "SvelteKit", "fullstack", "node"),
    ("angular", "Angular", "frontend", "node"),
    ("react", "React", "frontend", "node"),
    ("vue", "Vue", "frontend", "node"),
    ("svelte", "Svelte", "frontend", "node"),
    ("solid", "Solid", "frontend", "node"),
    ("preact", "Preact", "frontend", "node"),
    ("qwik", "Qwik", "frontend", "node"),
    ("express", "Express", "backend", "node"),
    ("fastify", "Fastify", "backend", "node"),
    ("nestjs", "NestJS", "backend", "node"),
    ("koa", "Koa", "backend", "node"),
    ("hono", "Hono", "backend", "node"),
    ("hapi", "hapi", "backend", "node"),
    ("elysia", "Elysia", "backend", "node"),
    ("adonisjs", "AdonisJS", "backend", "node"),
    ("trpc", "tRPC", "backend", "node"),
    ("gin", "Gin", "backend", "go"),
    ("echo", "Echo", "backend", "go"),
    ("chi", "chi", "backend", "go"),
    ("fiber", "Fiber", "backend", "go"),
    ("gorilla-mux", "Gorilla mux", "backend", "go"),
    ("grpc", "gRPC", "backend", "go"),
    ("astro", "Astro", "static-site", "node"),
    ("gatsby", "Gatsby", "static-site", "node"),
    ("docusaurus", "Docusaurus", "static-site", "node"),
    ("vitepress", "VitePress", "static-site", "node"),
    ("react-native", "React Native", "mobile", "node"),
    ("expo", "Expo", "mobile", "node"),
    ("electron", "Electron", "desktop", "node"),
    ("go-net-http", "net/http", "backend", "go"),
]
#: Categories in their order.
CATEGORIES = ["fullstack", "frontend", "backend", "static-site", "mobile", "desktop", "library"]
#: Dependency and the framework that it shows.
FRAMEWORK_PACKAGES = [
    ("nuxt", "nuxt"),
    ("next", "next"),
    ("@remix-run/react", "remix"),
    ("@react-router/dev", "react-router"),
    ("@sveltejs/kit", "sveltekit"),
    ("@angular/core", "angular"),
    ("react", "react"),
    ("vue", "vue"),
    ("svelte", "svelte"),
    ("solid-js", "solid"),
    ("preact", "preact"),
    ("@builder.io/qwik", "qwik"),
    ("express", "express"),
    ("fastify", "fastify"),
    ("@nestjs/core", "nestjs"),
    ("koa", "koa"),
    ("hono", "hono"),
    ("@hono/hono", "hono"),
    ("@hapi/hapi", "hapi"),
    ("elysia", "elysia"),
    ("@adonisjs/core", "adonisjs"),
    ("@trpc/server", "trpc"),
    ("github.com/gin-gonic/gin", "gin"),
    ("github.com/labstack/echo/v4", "echo"),
    ("github.com/labstack/echo", "echo"),
    ("github.com/go-chi/chi/v5", "chi"),
    ("github.com/go-chi/chi", "chi"),
    ("github.com/gofiber/fiber/v3", "fiber"),
    ("github.com/gofiber/fiber/v2", "fiber"),
    ("github.com/gorilla/mux", "gorilla-mux"),
    ("google.golang.org/grpc", "grpc"),
    ("astro", "astro"),
    ("gatsby", "gatsby"),
    ("@docusaurus/core", "docusaurus"),
    ("vitepress", "vitepress"),
    ("react-native", "react-native"),
    ("expo", "expo"),
    ("electron", "electron"),
]
#: Config file of a framework, relative to a package, and whether others have it too.
FRAMEWORK_CONFIGS = [
    (f"nuxt.config.{CODE}", "nuxt", False),
    (f"next.config.{CODE}", "next", False),
    (f"remix.config.{CODE}", "remix", False),
    (f"react-router.config.{CODE}", "react-router", False),
    (f"svelte.config.{CODE}", "sveltekit", True),
    ("angular.json", "angular", False),
    ("nest-cli.json", "nestjs", False),
    ("adonisrc.ts", "adonisjs", False),
    (".adonisrc.json", "adonisjs", False),
    (f"astro.config.{CODE}", "astro", False),
    (f"gatsby-config.{CODE}", "gatsby", False),
    (f"docusaurus.config.{CODE}", "docusaurus", False),
    (f".vitepress/config.{CODE}", "vitepress", False),
    (f"docs/.vitepress/config.{CODE}", "vitepress", False),
    ("eas.json", "expo", False),
    (f"forge.config.{CODE}", "electron", False),
    ("electron-builder.{json,json5,yml,yaml,toml}", "electron", False),
    (f"electron.vite.config.{CODE}", "electron", False),
]
#: Go frameworks that route HTTP.
GO_ROUTERS = ["gin", "echo", "chi", "fiber", "gorilla-mux"]

#: Database id, its name and kind.
DATABASES = [
    ("postgresql", "PostgreSQL", "relational"),
    ("mysql", "MySQL", "relational"),
    ("mariadb", "MariaDB", "relational"),
    ("sqlite", "SQLite", "relational"),
    ("libsql", "libSQL", "relational"),
    ("cockroachdb", "CockroachDB", "relational"),
    ("mssql", "SQL Server", "relational"),
    ("oracle", "Oracle Database", "relational"),
    ("singlestore", "SingleStore", "relational"),
    ("mongodb", "MongoDB", "document"),
    ("couchdb", "CouchDB", "document"),
    ("redis", "Redis", "key-value"),
    ("valkey", "Valkey", "key-value"),
    ("keydb", "KeyDB", "key-value"),
    ("dragonfly", "Dragonfly", "key-value"),
    ("memcached", "Memcached", "key-value"),
    ("dynamodb", "DynamoDB", "key-value"),
    ("cassandra", "Cassandra", "wide-column"),
    ("scylladb", "ScyllaDB", "wide-column"),
    ("clickhouse", "ClickHouse", "other"),
    ("surrealdb", "SurrealDB", "other"),
    ("neo4j", "Neo4j", "graph"),
    ("influxdb", "InfluxDB", "time-series"),
    ("elasticsearch", "Elasticsearch", "search"),
    ("opensearch", "OpenSearch", "search"),
]
#: Npm package that connects to one database, and the database.
NODE_DRIVERS = [
    ("pg", "postgresql"),
    ("pg-native", "postgresql"),
    ("postgres", "postgresql"),
    ("@neondatabase/serverless", "postgresql"),
    ("@vercel/postgres", "postgresql"),
    ("pg-promise", "postgresql"),
    ("slonik", "postgresql"),
    ("@prisma/adapter-pg", "postgresql"),
    ("@prisma/adapter-neon", "postgresql"),
    ("@mikro-orm/postgresql", "postgresql"),
    ("mysql", "mysql"),
    ("mysql2", "mysql"),
    ("@planetscale/database", "mysql"),
    ("@prisma/adapter-planetscale", "mysql"),
    ("@mikro-orm/mysql", "mysql"),
    ("mariadb", "mariadb"),
    ("@prisma/adapter-mariadb", "mariadb"),
    ("@mikro-orm/mariadb", "mariadb"),
    ("better-sqlite3", "sqlite"),
    ("sqlite3", "sqlite"),
    ("sqlite", "sqlite"),
    ("@prisma/adapter-better-sqlite3", "sqlite"),
    ("@prisma/adapter-d1", "sqlite"),
    ("@mikro-orm/sqlite", "sqlite"),
    ("@mikro-orm/better-sqlite", "sqlite"),
    ("@libsql/client", "libsql"),
    ("@prisma/adapter-libsql", "libsql"),
    ("@mikro-orm/libsql", "libsql"),
    ("mongodb", "mongodb"),
    ("mongoose", "mongodb"),
    ("@mikro-orm/mongodb", "mongodb"),
    ("redis", "redis"),
    ("ioredis", "redis"),
    ("@upstash/redis", "redis"),
    ("@redis/client", "redis"),
    ("iovalkey", "valkey"),
    ("@valkey/valkey-glide", "valkey"),
    ("memcached", "memcached"),
    ("memjs", "memcached"),
    ("@aws-sdk/client-dynamodb", "dynamodb"),
    ("@aws-sdk/lib-dynamodb", "dynamodb"),
    ("dynamoose", "dynamodb"),
    ("mssql", "mssql"),
    ("tedious", "mssql"),
    ("@prisma/adapter-mssql", "mssql"),
    ("@mikro-orm/mssql", "mssql"),
    ("oracledb", "oracle"),
    ("cassandra-driver", "cassandra"),
    ("neo4j-driver", "neo4j"),
    ("@influxdata/influxdb-client", "influxdb"),
    ("@elastic/elasticsearch", "elasticsearch"),
    ("@opensearch-project/opensearch", "opensearch"),
    ("@clickhouse/client", "clickhouse"),
]
#: Go module without its major version that connects to one database, and the database.
GO_DRIVERS = [
    ("github.com/lib/pq", "postgresql"),
    ("github.com/jackc/pgx", "postgresql"),
    ("gorm.io/driver/postgres", "postgresql"),
    ("github.com/go-sql-driver/mysql", "mysql"),
    ("gorm.io/driver/mysql", "mysql"),
    ("github.com/mattn/go-sqlite3", "sqlite"),
    ("modernc.org/sqlite", "sqlite"),
    ("github.com/glebarez/sqlite", "sqlite"),
    ("gorm.io/driver/sqlite", "sqlite"),
    ("github.com/tursodatabase/libsql-client-go", "libsql"),
    ("github.com/tursodatabase/go-libsql", "libsql"),
    ("go.mongodb.org/mongo-driver", "mongodb"),
    ("github.com/redis/go-redis", "redis"),
    ("github.com/go-redis/redis", "redis"),
    ("github.com/gomodule/redigo", "redis"),
    ("github.com/redis/rueidis", "redis"),
    ("github.com/valkey-io/valkey-go", "valkey"),
    ("github.com/bradfitz/gomemcache", "memcached"),
    ("github.com/microsoft/go-mssqldb", "mssql"),
    ("github.com/denisenkom/go-mssqldb", "mssql"),
    ("gorm.io/driver/sqlserver", "mssql"),
    ("github.com/sijms/go-ora", "oracle"),
    ("github.com/godror/godror", "oracle"),
    ("github.com/gocql/gocql", "cassandra"),
    ("github.com/neo4j/neo4j-go-driver", "neo4j"),
    ("github.com/influxdata/influxdb-client-go", "influxdb"),
    ("github.com/elastic/go-elasticsearch", "elasticsearch"),
    ("github.com/opensearch-project/opensearch-go", "opensearch"),
    ("github.com/ClickHouse/clickhouse-go", "clickhouse"),
    ("gorm.io/driver/clickhouse", "clickhouse"),
    ("github.com/aws/aws-sdk-go-v2/service/dynamodb", "dynamodb"),
]
#: Scheme of a connection string and the database.
URL_SCHEMES = [
    ("postgres", "postgresql"),
    ("postgresql", "postgresql"),
    ("mysql", "mysql"),
    ("mariadb", "mariadb"),
    ("mongodb", "mongodb"),
    ("mongodb+srv", "mongodb"),
    ("redis", "redis"),
    ("rediss", "redis"),
    ("valkey", "valkey"),
    ("valkeys", "valkey"),
    ("libsql", "libsql"),
    ("sqlserver", "mssql"),
    ("mssql", "mssql"),
    ("neo4j", "neo4j"),
    ("neo4j+s", "neo4j"),
    ("bolt", "neo4j"),
    ("clickhouse", "clickhouse"),
    ("cockroachdb", "cockroachdb"),
]
#: Beginning of a variable's name and the database that it hints at.
NAME_PREFIXES = [
    ("POSTGRES_", "postgresql"),
    ("POSTGRESQL_", "postgresql"),
    ("MYSQL_", "mysql"),
    ("MARIADB_", "mariadb"),
    ("MONGO_", "mongodb"),
    ("MONGODB_", "mongodb"),
    ("REDIS_", "redis"),
    ("VALKEY_", "valkey"),
    ("MEMCACHE_", "memcached"),
    ("MEMCACHED_", "memcached"),
    ("TURSO_", "libsql"),
    ("LIBSQL_", "libsql"),
    ("MSSQL_", "mssql"),
    ("CLICKHOUSE_", "clickhouse"),
    ("CASSANDRA_", "cassandra"),
    ("NEO4J_", "neo4j"),
    ("INFLUX_", "influxdb"),
    ("INFLUXDB_", "influxdb"),
    ("ELASTICSEARCH_", "elasticsearch"),
    ("ELASTIC_", "elasticsearch"),
    ("OPENSEARCH_", "opensearch"),
    ("COCKROACH_", "cockroachdb"),
    ("COCKROACHDB_", "cockroachdb"),
]
#: Whole names that hint at a database.
WHOLE_NAMES = [
    ("PGHOST", "postgresql"),
    ("PGHOSTADDR", "postgresql"),
    ("PGPORT", "postgresql"),
    ("PGUSER", "postgresql"),
    ("PGPASSWORD", "postgresql"),
    ("PGDATABASE", "postgresql"),
    ("PGSSLMODE", "postgresql"),
    ("PGPASSFILE", "postgresql"),
    ("PGSERVICE", "postgresql"),
    ("PGOPTIONS", "postgresql"),
    ("PGAPPNAME", "postgresql"),
    ("PGCONNECT_TIMEOUT", "postgresql"),
    ("REDIS", "redis"),
]

#: Technology id, its name, kind, and a repository that holds it (without a slash also the last part of any).
IMAGES = [
    ("postgresql", "PostgreSQL", "database", "postgres"),
    ("postgresql", "PostgreSQL", "database", "postgresql"),
    ("postgresql", "PostgreSQL", "database", "postgis"),
    ("postgresql", "PostgreSQL", "database", "timescaledb"),
    ("postgresql", "PostgreSQL", "database", "timescaledb-ha"),
    ("postgresql", "PostgreSQL", "database", "pgvector"),
    ("mysql", "MySQL", "database", "mysql"),
    ("mysql", "MySQL", "database", "mysql-server"),
    ("mysql", "MySQL", "database", "mysql/community-server"),
    ("mariadb", "MariaDB", "database", "mariadb"),
    ("mongodb", "MongoDB", "database", "mongo"),
    ("mongodb", "MongoDB", "database", "mongodb"),
    ("mongodb", "MongoDB", "database", "mongodb-community-server"),
    ("cockroachdb", "CockroachDB", "database", "cockroach"),
    ("cockroachdb", "CockroachDB", "database", "cockroachdb"),
    ("clickhouse", "ClickHouse", "database", "clickhouse"),
    ("clickhouse", "ClickHouse", "database", "clickhouse-server"),
    ("cassandra", "Cassandra", "database", "cassandra"),
    ("scylladb", "ScyllaDB", "database", "scylla"),
    ("scylladb", "ScyllaDB", "database", "scylladb"),
    ("neo4j", "Neo4j", "database", "neo4j"),
    ("influxdb", "InfluxDB", "database", "influxdb"),
    ("couchdb", "CouchDB", "database", "couchdb"),
    ("surrealdb", "SurrealDB", "database", "surrealdb"),
    ("mssql", "SQL Server", "database", "mssql/server"),
    ("mssql", "SQL Server", "database", "azure-sql-edge"),
    ("dynamodb", "DynamoDB", "database", "dynamodb-local"),
    ("redis", "Redis", "cache", "redis"),
    ("redis", "Redis", "cache", "redis-stack"),
    ("redis", "Redis", "cache", "redis-stack-server"),
    ("redis", "Redis", "cache", "redis/redis-stack"),
    ("redis", "Redis", "cache", "redis/redis-stack-server"),
    ("valkey", "Valkey", "cache", "valkey"),
    ("keydb", "KeyDB", "cache", "keydb"),
    ("dragonfly", "Dragonfly", "cache", "dragonfly"),
    ("memcached", "Memcached", "cache", "memcached"),
    ("rabbitmq", "RabbitMQ", "queue", "rabbitmq"),
    ("nats", "NATS", "queue", "nats"),
    ("nats", "NATS", "queue", "nats-streaming"),
    ("kafka", "Kafka", "queue", "kafka"),
    ("kafka", "Kafka", "queue", "kafka-native"),
    ("kafka", "Kafka", "queue", "cp-kafka"),
    ("kafka", "Kafka", "queue", "cp-server"),
    ("redpanda", "Redpanda", "queue", "redpanda"),
    ("zookeeper", "ZooKeeper", "other", "zookeeper"),
    ("zookeeper", "ZooKeeper", "other", "cp-zookeeper"),
    ("elasticsearch", "Elasticsearch", "search", "elasticsearch"),
    ("opensearch", "OpenSearch", "search", "opensearch"),
    ("meilisearch", "Meilisearch", "search", "meilisearch"),
    ("typesense", "Typesense", "search", "typesense"),
    ("solr", "Solr", "search", "solr"),
    ("minio", "MinIO", "storage", "minio"),
    ("azurite", "Azurite", "storage", "azurite"),
    ("localstack", "LocalStack", "other", "localstack"),
    ("mailpit", "Mailpit", "mail", "mailpit"),
    ("mailhog", "MailHog", "mail", "mailhog"),
    ("maildev", "MailDev", "mail", "maildev"),
    ("smtp4dev", "smtp4dev", "mail", "smtp4dev"),
    ("nginx", "nginx", "proxy", "nginx"),
    ("nginx", "nginx", "proxy", "nginx-unprivileged"),
    ("traefik", "Traefik", "proxy", "traefik"),
    ("caddy", "Caddy", "proxy", "caddy"),
    ("haproxy", "HAProxy", "proxy", "haproxy"),
    ("envoy", "Envoy", "proxy", "envoy"),
    ("prometheus", "Prometheus", "observability", "prometheus"),
    ("grafana", "Grafana", "observability", "grafana"),
    ("grafana", "Grafana", "observability", "grafana-oss"),
    ("grafana", "Grafana", "observability", "grafana-enterprise"),
    ("grafana", "Grafana", "observability", "otel-lgtm"),
    ("jaeger", "Jaeger", "observability", "jaeger"),
    ("jaeger", "Jaeger", "observability", "jaegertracing/all-in-one"),
    ("opentelemetry-collector", "OpenTelemetry Collector", "observability", "opentelemetry-collector"),
    ("opentelemetry-collector", "OpenTelemetry Collector", "observability", "opentelemetry-collector-contrib"),
    ("opentelemetry-collector", "OpenTelemetry Collector", "observability", "opentelemetry-collector-k8s"),
    ("loki", "Loki", "observability", "loki"),
    ("tempo", "Tempo", "observability", "tempo"),
    ("zipkin", "Zipkin", "observability", "zipkin"),
    ("kibana", "Kibana", "observability", "kibana"),
    ("keycloak", "Keycloak", "other", "keycloak"),
    ("temporal", "Temporal", "other", "temporalio/auto-setup"),
    ("temporal", "Temporal", "other", "temporalio/server"),
    ("temporal", "Temporal", "other", "temporalio/temporal"),
    ("adminer", "Adminer", "other", "adminer"),
    ("pgadmin", "pgAdmin", "other", "pgadmin4"),
    ("phpmyadmin", "phpMyAdmin", "other", "phpmyadmin"),
]
#: Official image of a runtime, and the runtime.
RUNTIME_IMAGES = [
    ("node", "node"),
    ("golang", "go"),
    ("php", "php"),
    ("oven/bun", "bun"),
    ("denoland/deno", "deno"),
]
#: Registries that hold the official images under their own names.
HUB_REGISTRIES = ["docker.io", "index.docker.io", "registry-1.docker.io", "mirror.gcr.io"]


def table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """Rows of this module as a DataFrame with their position, ``ord``."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{columns}, ord int")


def framework_packages(spark: SparkSession) -> DataFrame:
    of = dict((f[0], f[3]) for f in FRAMEWORKS)
    return table(spark, [(p, f, of[f]) for p, f in FRAMEWORK_PACKAGES], "name string, id string, ecosystem string")


def framework_configs(spark: SparkSession) -> DataFrame:
    return table(spark, FRAMEWORK_CONFIGS, "pattern string, id string, weak boolean")


def drivers(spark: SparkSession) -> DataFrame:
    rows = [(n, "node", d) for n, d in NODE_DRIVERS] + [(n, "go", d) for n, d in GO_DRIVERS]
    return table(spark, rows, "name string, ecosystem string, id string")


def images(spark: SparkSession) -> DataFrame:
    return table(spark, IMAGES, "id string, name string, kind string, repository string")

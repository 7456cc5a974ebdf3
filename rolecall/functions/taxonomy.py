"""Categories and technology tags, held as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rolecall import schemas

# The category keywords. One line per category and field, in
# order; a keyword listed twice counts twice.
CATEGORY_TEXT = """
Frontend | title | frontend, front-end, front end, frontend, ui developer, ui engineer, react developer, vue developer, angular developer, web developer, javascript developer, typescript developer
Frontend | description | frontend, front-end, user interface, ui/ux, responsive design, css, html, dom, browser
Backend | title | backend, back-end, back end, server-side, api developer, python developer, java developer, golang developer, go developer, node developer, nodejs developer, .net developer, c# developer
Backend | description | backend, back-end, server-side, api, microservices, database, sql, rest api, graphql
Fullstack | title | fullstack, full-stack, full stack, software engineer, software developer, web developer
Fullstack | description | fullstack, full-stack, full stack, end-to-end, frontend and backend, front-end and back-end
DevOps | title | devops, sre, site reliability, platform engineer, infrastructure engineer, cloud engineer, systems engineer, devsecops, mlops, dataops
DevOps | description | devops, ci/cd, continuous integration, continuous deployment, infrastructure as code, terraform, ansible, kubernetes, docker, containerization, orchestration, monitoring
AI | title | ai engineer, ml engineer, machine learning, data scientist, deep learning, nlp engineer, computer vision, llm engineer, ai/ml, artificial intelligence, generative ai, genai
AI | description | machine learning, deep learning, neural network, tensorflow, pytorch, nlp, natural language processing, computer vision, llm, large language model, generative ai, transformers, hugging face, openai, langchain, langgraph, rag, retrieval augmented, fine-tuning, model training
"""

# The tag keywords. One line per tag, in order.
TAG_TEXT = """
languages | Python | python, py
languages | JavaScript | javascript, js
languages | TypeScript | typescript, ts
languages | Java | java, jvm
languages | Go | golang, go
languages | C++ | c++, cpp
languages | C# | c#, csharp, .net
languages | Rust | rust, rustlang
languages | Ruby | ruby, rails
languages | PHP | php, laravel
languages | Scala | scala
languages | Kotlin | kotlin
languages | Swift | swift
cloud | AWS | aws, amazon web services, ec2, s3, lambda, dynamodb, eks, ecs
cloud | Azure | azure, microsoft azure, azure devops
cloud | GCP | gcp, google cloud
cloud | Vercel | vercel
cloud | Cloudflare | cloudflare, cloudflare workers
frameworks | React | react, reactjs, react.js
frameworks | Next.js | next.js, nextjs, next js
frameworks | Vue | vue, vuejs, vue.js, nuxt
frameworks | Angular | angular, angularjs
frameworks | Svelte | svelte, sveltekit
frameworks | FastAPI | fastapi, fast api
frameworks | Django | django
frameworks | Flask | flask
frameworks | Express | express, expressjs, express.js
frameworks | NestJS | nestjs, nest.js
frameworks | .NET | .net, dotnet, asp.net
frameworks | Spring Boot | spring boot, springboot, spring framework
frameworks | Rails | ruby on rails, rails
frameworks | Laravel | laravel
ai_tools | LangChain | langchain, lang chain
ai_tools | LangGraph | langgraph, lang graph
ai_tools | TensorFlow | tensorflow, tf
ai_tools | PyTorch | pytorch, torch
ai_tools | Hugging Face | hugging face, huggingface, transformers
ai_tools | OpenAI | openai, gpt-4, gpt-3, chatgpt
ai_tools | LlamaIndex | llamaindex, llama index
ai_tools | Scikit-learn | scikit-learn, sklearn
ai_tools | Pandas | pandas
ai_tools | NumPy | numpy
databases | PostgreSQL | postgresql, postgres, psql
databases | MySQL | mysql
databases | MongoDB | mongodb, mongo
databases | Redis | redis
databases | Elasticsearch | elasticsearch, elastic search, elk
databases | DynamoDB | dynamodb
databases | Cassandra | cassandra
devops_tools | Docker | docker, containerization
devops_tools | Kubernetes | kubernetes, k8s
devops_tools | Terraform | terraform, iac
devops_tools | Ansible | ansible
devops_tools | Jenkins | jenkins
devops_tools | GitHub Actions | github actions, gh actions
devops_tools | GitLab CI | gitlab ci, gitlab-ci
devops_tools | ArgoCD | argocd, argo cd
devops_tools | Helm | helm, helm charts
devops_tools | Prometheus | prometheus
devops_tools | Grafana | grafana
devops_tools | DataDog | datadog
other | GraphQL | graphql, graph ql
other | REST API | rest api, restful
other | gRPC | grpc, g-rpc
other | Kafka | kafka, apache kafka
other | RabbitMQ | rabbitmq, rabbit mq
other | WebSocket | websocket, websockets, ws
other | Microservices | microservices, micro-services
other | Serverless | serverless, faas
other | Agile | agile, scrum, kanban
other | Git | git, github, gitlab, bitbucket
"""

DEFAULT_CATEGORY = "Fullstack"
TITLE_WEIGHT = 3
DESCRIPTION_WEIGHT = 1


@dataclass(frozen=True)
class Taxonomy:
    """Keyword rows, in order: ``(category, field, keyword, weight)`` and
    ``(tag_group, tag, keyword)``."""

    category_rows: tuple[tuple[str, str, str, int], ...]
    tag_rows: tuple[tuple[str, str, str], ...]
    default_category: str = DEFAULT_CATEGORY

    def __post_init__(self) -> None:
        if any(not row[2] for row in self.category_rows + self.tag_rows):
            raise ValueError("a taxonomy keyword may not be empty")
        if any(row[2] != row[2].strip() for row in self.category_rows + self.tag_rows):
            raise ValueError("a taxonomy keyword may not begin or end with white space")

    @property
    def categories(self) -> list[str]:
        return list(dict.fromkeys(row[0] for row in self.category_rows))

    @property
    def tags_by_group(self) -> dict[str, list[str]]:
        groups: dict[str, dict[str, None]] = {}
        for group, tag, _ in self.tag_rows:
            groups.setdefault(group, {})[tag] = None
        return {group: list(tags) for group, tags in groups.items()}

    @property
    def flat_tags(self) -> list[str]:
        return sorted(tag for tags in self.tags_by_group.values() for tag in tags)

    def keywords_of_tags(self) -> dict[str, list[str]]:
        """Tag to keywords over all groups, in code-point order of the tag."""
        found: dict[str, list[str]] = {}
        for _, tag, keyword in self.tag_rows:
            found.setdefault(tag, []).append(keyword)
        return {tag: found[tag] for tag in sorted(found)}

    @classmethod
    def from_text(cls, categories: str, tags: str,
                  default_category: str = DEFAULT_CATEGORY) -> "Taxonomy":
        """Tables written as ``name | name | keyword, keyword`` lines."""
        weights = {"title": TITLE_WEIGHT, "description": DESCRIPTION_WEIGHT}

        def rows(text):
            for line in filter(None, map(str.strip, text.splitlines())):
                first, second, keywords = (part.strip() for part in line.split("|", 2))
                for keyword in keywords.split(", "):
                    yield first, second, keyword

        return cls(
            tuple((c, f, k, weights[f]) for c, f, k in rows(categories)),
            tuple(rows(tags)),
            default_category,
        )

    @classmethod
    def from_frames(cls, categories: DataFrame, tags: DataFrame,
                    default_category: str = DEFAULT_CATEGORY) -> "Taxonomy":
        """A taxonomy from keyword tables. They become part of the plan, so they
        are read to the driver, all of them."""
        cats = categories.orderBy("category_ord", "field", "kw_ord")
        tag_rows = tags.orderBy("tag_group", "tag", "kw_ord")
        return cls(
            tuple((r.category, r.field, r.keyword, r.weight) for r in cats.collect()),
            tuple((r.tag_group, r.tag, r.keyword) for r in tag_rows.collect()),
            default_category,
        )


DEFAULT_TAXONOMY = Taxonomy.from_text(CATEGORY_TEXT, TAG_TEXT)


def category_keywords(spark: SparkSession, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """One row per listed category keyword, repeats kept."""
    ords = {name: i for i, name in enumerate(taxonomy.categories)}
    place: dict[tuple[str, str], int] = {}
    rows = []
    for category, field, keyword, weight in taxonomy.category_rows:
        kw_ord = place[category, field] = place.get((category, field), -1) + 1
        rows.append((category, ords[category], field, kw_ord, keyword, weight))
    return spark.createDataFrame(rows, schemas.CATEGORY_KEYWORDS)


def tag_keywords(spark: SparkSession, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """One row per listed tag keyword."""
    place: dict[tuple[str, str], int] = {}
    rows = []
    for group, tag, keyword in taxonomy.tag_rows:
        kw_ord = place[group, tag] = place.get((group, tag), -1) + 1
        rows.append((group, tag, kw_ord, keyword))
    return spark.createDataFrame(rows, schemas.TAG_KEYWORDS)


def all_categories(keywords: DataFrame) -> DataFrame:
    """Category names in their order."""
    return keywords.select("category", "category_ord").distinct().orderBy("category_ord")


def all_tags(keywords: DataFrame) -> DataFrame:
    """Tags of each group."""
    return keywords.groupBy("tag_group").agg(
        F.array_sort(F.collect_set("tag")).alias("tags"))


def flat_tags(keywords: DataFrame) -> DataFrame:
    """All tag names, sorted."""
    return keywords.select("tag").distinct().orderBy("tag")

"""Paths that tools and frameworks call by themselves: globs behind an inverted index, some only where the nearest manifest has the framework."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.languages import language
from loomline.functions.paths import ancestors, basename, dirname, glob_regex
from loomline.operators.lineage import cut
from loomline.plans import manifests

J = "{js,jsx,mjs,cjs,ts,tsx,mts,cts}"
#: By what calls them: after the manuals of the tools, which find these files by their path. Earlier ones give the reason.
TOOLS: dict[str, list[str]] = {
    "babel": [f"**/.babelrc.{J}", f"**/babel.config.{J}"],
    "eslint": [f"**/.eslintrc.{J}", f"**/eslint.config.{J}"],
    "prettier": [f"**/.prettierrc.{J}"],
    "stylelint": [f"**/.stylelintrc.{J}"],
    "commit tools": [f"**/.{{commitlintrc,lintstagedrc,czrc,releaserc,huskyrc}}.{J}"],
    "mocha": [f"**/.mocharc.{J}"],
    "storybook": [f"**/.storybook/*.{J}", f"**/*.{{story,stories}}.{J}"],
    "task runner": [f"**/{{Gruntfile,gulpfile,Gulpfile,Jakefile,Cakefile}}.{J}"],
    "karma": [f"**/karma.*.{J}", f"**/karma.conf.{J}"],
    "protractor": [f"**/protractor.*.{J}"],
    "webdriver": [f"**/wdio.*.{J}", f"**/nightwatch.conf.{J}"],
    "knex": [f"**/knexfile.{J}"],
    "process manager": [f"**/ecosystem.config.{J}", f"**/pm2.config.{J}"],
    "gatsby": [f"**/gatsby-{{browser,config,node,ssr}}.{J}"],
    "docs site": [f"**/.vitepress/**/*.{J}", f"**/.vuepress/**/*.{J}", f"**/sidebars.{J}"],
    "service worker": [f"**/{{sw,service-worker,serviceWorker,firebase-messaging-sw}}.{J}"],
    "test setup": [f"**/{{setupTests,setup-tests,jest-setup,jest.setup,vitest.setup,test-setup,setup-jest,globalSetup,globalTeardown}}.{J}"],
    "test": [f"**/*.{{test,spec,e2e,e2e-spec,cy,bench,test-d}}.{J}", f"**/__tests__/**/*.{J}", f"**/cypress/{{e2e,integration,support,plugins}}/**/*.{J}"],
    "mocks": [f"**/__mocks__/**/*.{J}"],
    "monorepo generator": ["**/{generators,schematics,executors,builders}/**/{schema,index,generator,executor,impl}.ts"],
    "functions host": [f"**/netlify/{{functions,edge-functions}}/**/*.{J}", f"**/supabase/functions/**/*.{J}", f"**/functions/_middleware.{J}"],
    "browser extension": [f"**/{{content-script,contentScript,content_script,background}}.{J}"],
    "django": ["**/{manage,wsgi,asgi}.py", "**/{settings,urls,admin,apps,signals}.py", "**/settings/*.py", "**/management/commands/*.py", "**/templatetags/*.py"],
    "migration": ["**/migrations/*.{py,rb,js,ts,cs}", "**/alembic/**/*.py", "**/Migrations/*.cs", "**/db/migrate/**/*.{js,ts}"],
    "python packaging": ["**/{setup,hatch_build,sitecustomize,usercustomize}.py", "**/__main__.py"],
    "python tasks": ["**/{noxfile,fabfile,dodo,tasks,celery,celeryconfig}.py", "**/{gunicorn,gunicorn_conf,uwsgi}.py", "**/*.conf.py"],
    "pytest": ["**/{conftest,pytest_plugins}.py", "**/test_*.py", "**/*_test.py"],
    "sphinx": ["**/{docs,doc}/**/conf.py"],
    "airflow": ["**/dags/**/*.py"],
    "jupyter": ["**/jupyter_*_config.py", "**/ipython_config.py"],
    "streamlit": ["**/streamlit_app.py", "**/.streamlit/*.py"],
    "scrapy": ["**/spiders/*.py"],
    "locust": ["**/locustfile.py"],
    "cargo": ["**/build.rs", "**/src/{main,lib}.rs", "**/src/bin/**/*.rs", "**/{benches,examples,tests}/**/*.rs", "**/fuzz_targets/*.rs", "**/xtask/src/main.rs"],
    "go tools": ["**/{main,doc,tools,wire,magefile,generate}.go", "**/*_test.go", "**/cmd/**/main.go", "**/examples/**/*.go", "**/magefiles/*.go"],
    "jvm": ["**/{module-info,package-info}.java", "**/*Application.{java,kt}", "**/*{Test,Tests,IT,Spec,TestCase}.{java,kt}", "**/src/{test,androidTest,integrationTest,jmh}/**/*.{java,kt}", "**/buildSrc/**/*.{java,kt,kts}", "**/*.gradle.kts"],
    "android": ["**/*{Activity,Fragment,Receiver,ContentProvider}.{java,kt}"],
    "dotnet": ["**/{Program,Startup,GlobalUsings,AssemblyInfo,MauiProgram}.cs", "**/*{Tests,Test,Specs,Fixture}.cs", "**/*.{cshtml,razor,xaml,axaml}.cs", "**/*.{g,Designer,designer}.cs", "**/*Controller.cs", "**/*{Hub,Middleware}.cs"],
    "scripts": [f"{{bin,scripts,tools,hack,tasks,ci,.github}}/**/*.{J}", "{bin,scripts,tools,hack,tasks,ci,.github}/**/*.py"],
    "worker": [f"**/*.{{worker,sharedworker,worklet}}.{J}"],
}
#: Packages by which a framework is known, and the globs of what it calls, below the package that has it.
FRAMEWORKS: dict[str, tuple[tuple[str, ...], list[str]]] = {
    "adonis": (("@adonisjs/core",), ["**/app/{controllers,middleware,models,validators}/**/*.ts", "**/{start,providers,commands,config}/**/*.ts"]),
    "angular": (("@angular/core",), ["**/*.{component,module,directive,pipe,guard,resolver,interceptor}.ts", "**/{main,polyfills,test}.ts", "**/environments/*.ts"]),
    "astro": (("astro",), [f"**/src/{{pages,content}}/**/*.{J}", f"**/src/middleware.{J}"]),
    "docusaurus": (("@docusaurus/core",), [f"**/src/{{pages,theme}}/**/*.{J}"]),
    "electron": (("electron",), [f"**/{{main,preload,renderer}}.{J}", f"**/electron/**/*.{J}"]),
    "ember": (("ember-source",), ["**/app/{adapters,components,controllers,helpers,initializers,models,routes,serializers,services,transforms}/**/*.{js,ts}"]),
    "eslint": (("eslint",), ["**/{eslint,.eslint}*.{js,mjs,cjs}"]),
    "expo": (("expo-router",), [f"**/app/**/*.{J}"]),
    "fastify": (("@fastify/autoload", "fastify-autoload"), [f"**/{{plugins,routes}}/**/*.{J}"]),
    "gatsby": (("gatsby",), [f"**/src/{{pages,templates,api}}/**/*.{J}"]),
    "hardhat": (("hardhat",), [f"**/{{deploy,ignition}}/**/*.{J}", f"**/hardhat.config.{J}"]),
    "nestjs": (("@nestjs/core", "@nestjs/common"), ["**/*.{controller,module,resolver,gateway,guard,interceptor,pipe}.ts"]),
    "next": (("next",), [f"**/pages/**/*.{J}", f"**/app/**/{{page,layout,route,loading,error,template,default,not-found,global-error,icon,apple-icon,opengraph-image,twitter-image,sitemap,robots,manifest}}.{J}", f"**/{{middleware,instrumentation,instrumentation-client}}.{J}"]),
    "nuxt": (("nuxt", "nuxt3"), ["**/{components,composables,layouts,middleware,pages,plugins,server,stores,utils}/**"]),
    "oclif": (("@oclif/core", "@oclif/command"), ["**/commands/**/*.{js,ts,mjs,cjs,jsx,tsx}"]),
    "pinia": (("pinia", "vuex"), ["**/{store,stores}/*.{js,ts}"]),
    "plasmo": (("plasmo",), [f"**/{{background,popup,options,content,contents,sidepanel,newtab}}/**/*.{J}", f"**/{{popup,options,sidepanel,newtab}}.{J}"]),
    "qwik": (("@builder.io/qwik-city",), [f"**/routes/**/*.{J}", f"**/entry.*.{J}"]),
    "redwood": (("@redwoodjs/core",), ["**/api/src/{functions,graphql,services,directives}/**/*.{js,ts}", "**/web/src/{pages,layouts}/**/*.{jsx,tsx}", "**/web/src/Routes.{jsx,tsx}"]),
    "remix": (("@remix-run/react", "@react-router/dev"), [f"**/app/routes/**/*.{J}", f"**/app/{{root,routes}}.{J}", f"**/entry.{{client,server}}.{J}"]),
    "sails": (("sails",), ["**/api/{controllers,models,policies,services,helpers,hooks}/**/*.js", "**/config/**/*.js"]),
    "sequelize": (("sequelize", "sequelize-cli"), ["**/{models,seeders}/*.{js,ts}"]),
    "solid": (("@solidjs/start", "solid-start"), [f"**/routes/**/*.{J}", f"**/entry-{{client,server}}.{J}"]),
    "strapi": (("@strapi/strapi",), ["**/src/{api,extensions,plugins,admin}/**/*.{js,ts}", "**/config/**/*.{js,ts}"]),
    "svelte": (("@sveltejs/kit",), ["**/routes/**/+*.{svelte,js,ts}", "**/hooks.{client,server}.{js,ts}", "**/{params,service-worker}/*.{js,ts}"]),
    "typeorm": (("typeorm",), ["**/*.{entity,subscriber}.{js,ts}"]),
    "vue": (("vue",), ["**/{router,plugins}/*.{js,ts}"]),
    "wxt": (("wxt",), [f"**/entrypoints/**/*.{J}"]),
}
#: Files of configuration by which a framework is known where no manifest names it.
CONFIGURED = {"astro": "astro.config", "next": "next.config", "nuxt": "nuxt.config", "svelte": "svelte.config", "remix": "remix.config", "gatsby": "gatsby-config", "docusaurus": "docusaurus.config", "wxt": "wxt.config"}


def braces(glob: str) -> list[str]:
    """A glob for each choice of its alternatives, which don't nest."""
    parts = re.split(r"\{([^{}]*)\}", glob)
    choices = [p.split(",") if i % 2 else [p] for i, p in enumerate(parts)]
    return ["".join(x) for x in product(*choices)]


def literal(glob: str) -> str:
    """What every path that a glob without braces matches has: its name (b:), a folder (f:), or an end of its name from a dot on (x:)."""
    *folders, last = glob.split("/")
    if "*" not in last:
        return f"b:{last}"
    plain = [f for f in folders if "*" not in f]
    if plain:
        return f"f:{max(plain, key=len)}"
    end = last.rpartition("*")[2]
    return f"x:{end if end.startswith('.') else '.' + end.rpartition('.')[2]}"


def rules() -> list[tuple[int, str, str, str, list[str]]]:
    """(rank, reason, key, pattern, packages) of all globs; those of frameworks have the packages that they ask for."""
    out = []
    named = [(reason, globs, ()) for reason, globs in TOOLS.items()] + [(f"framework {name}", globs, packages) for name, (packages, globs) in FRAMEWORKS.items()]
    for rank, (reason, globs, packages) in enumerate(named):
        by_key: dict[str, list[str]] = {}
        for g in globs:
            for one in braces(g):
                by_key.setdefault(literal(one), []).append(one)
        out += [(rank, reason, key, "|".join(glob_regex(g) for g in some), list(packages)) for key, some in by_key.items()]
    return out


def tokens(path: Column | str) -> Column:
    """The keys that a path answers to: its name, its folders, and the ends of its name from each dot on."""
    name, parts = basename(path), F.split(F.col(path) if isinstance(path, str) else path, "/", -1)
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(F.lit("f:"), x))
    dots = F.split(name, r"\.", -1)
    ends = F.transform(F.slice(F.sequence(F.lit(1), F.size(dots)), 2, F.size(dots)), lambda i: F.concat(F.lit("x:."), F.array_join(F.slice(dots, i, F.size(dots)), ".")))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("b:"), name)), folders, ends))


def candidates(paths: DataFrame) -> DataFrame:
    """(path, rank, reason, packages): the rules that a path matches. A rule's patterns are tried on paths only that have its key; the rules, a few thousand keys whatever the input, are broadcast."""
    spark = paths.sparkSession
    table = spark.createDataFrame(rules(), "rank int, reason string, key string, pattern string, packages array<string>")
    met = paths.select("path", F.explode(tokens("path")).alias("key")).join(F.broadcast(table), "key")
    return met.where(F.expr("path rlike pattern")).select("path", "rank", "reason", "packages")


def nearest(paths: DataFrame, homes: DataFrame) -> DataFrame:
    """(path, dir): the deepest folder of `homes` (dir) at or above each path, by an equi-join on exploded ancestors."""
    probes = paths.select("path", F.explode(ancestors("path")).alias("dir"))
    return probes.join(homes.select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def packages_of(files: DataFrame) -> DataFrame:
    """(dir, package): what each manifest depends on, and frameworks that a configuration below it shows."""
    fields = F.array(*(F.map_keys(F.from_json(F.get_json_object("json", f"$.{f}"), manifests.JSON_MAP)) for f in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")))
    rows = manifests.manifests(files)
    told = rows.select("dir", F.explode(F.flatten(F.filter(fields, lambda x: x.isNotNull()))).alias("package"))
    names = [n for n, *_ in FRAMEWORKS.items()]
    label = F.lit(None).cast("string")
    for name in (n for n in names if n in CONFIGURED):
        label = F.when(basename("path").rlike(rf"^{re.escape(CONFIGURED[name])}\.[cm]?[jt]s\z"), FRAMEWORKS[name][0][0]).otherwise(label)
    shown = files.select("path", label.alias("package")).where("package is not null")
    return told.union(nearest(shown, rows).join(shown, "path").select("dir", "package")).distinct()


def rule_entries(files: DataFrame) -> DataFrame:
    """(path, reason): the first rule that each path matches; a framework's only if the nearest manifest above the path has it."""
    found = cut(candidates(files.where(language("path").isNotNull()).select("path")))
    free = found.where(F.size("packages") == 0).select("path", "rank", "reason")
    bound = found.where(F.size("packages") > 0)
    if bound.isEmpty() or manifests.manifests(files).isEmpty():
        return free.groupBy("path").agg(F.min_by("reason", "rank").alias("reason"))
    asked = bound.select("path", "rank", "reason", F.explode("packages").alias("package"))
    homes = nearest(bound.select("path").distinct(), manifests.manifests(files))
    held = asked.join(homes, "path").join(packages_of(files), ["dir", "package"], "left_semi").select("path", "rank", "reason")
    return free.union(held).groupBy("path").agg(F.min_by("reason", "rank").alias("reason"))

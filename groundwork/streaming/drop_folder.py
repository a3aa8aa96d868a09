"""New pack files as a stream.

Cleaning, front matter and cutting work row by row, so the batch functions run on a
stream of files unchanged. Source numbers depend on a whole pack and stay a batch step.
"""

from groundwork import schemas
from groundwork.sources import packs


def stream(spark, folder, files_per_trigger=1000):
    return (spark.readStream.format("binaryFile").schema(schemas.FILES).option("pathGlobFilter", "*.md")
            .option("maxFilesPerTrigger", files_per_trigger).load(folder))


def parsed(files):
    """Cleaned files with fields and fault, without any state."""
    return packs.parsed(packs.named(files))


def start(parsed_files, path, checkpoint):
    """Append parsed files to Parquet; the checkpoint folder makes every file count once."""
    return (parsed_files.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

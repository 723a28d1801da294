from quillbit.cli import main

raise SystemExit(main())
